"""A session over a project: builds layers and answers viewport, tile, static, jump and update requests."""

from __future__ import annotations

import time
from collections import OrderedDict, deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.operators import charts, layouts, mutations, pyramid, tables, viewport
from zoomloom.operators.placement import place
from zoomloom.operators.viewport import Box
from zoomloom.session import discard, materialize
from zoomloom.sources import manifest
from zoomloom.sources.sinks import load_document, log_fetch, save_document
from zoomloom.spec import navigation
from zoomloom.spec.model import LITERAL_IN, LITERAL_OUT, Jump, Layer, Project, fingerprints, stale_layers
from zoomloom.spec.predicates import Everything, Predicate, check_columns, from_json, parse_wire, to_column

CACHED_TILES = 10
KEPT_FETCHES = 100  # tables of fetches that can still be read; older ones are deleted
EVENTS = ("pan", "zoom", "jumpstart", "jumpend")


class Engine:
    """folder: where built layers, documents and the log are written. Fetches run at once: their rows lie in the shared folder, so a state is
    never computed again, and the log has the true time and number of rows. The tile cache holds Arrow tables of single tiles."""

    def __init__(self, spark: SparkSession, folder: str, log: bool = False):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), log
        self.project: Project | None = None
        self._tiles: OrderedDict = OrderedDict()
        self._layers: dict[tuple[str, int], layouts.Written] = {}
        self._held: dict[tuple, tuple[Box, dict[int, DataFrame]]] = {}
        self._predicates: dict[tuple, dict[int, Predicate]] = {}
        self._at: dict[str, tuple[str, float, float]] = {}
        self._entries: list[tuple] = []
        self._made: deque[DataFrame] = deque()
        self._listeners: dict[str, list] = {}

    # building

    def load(self, p: Project, force: bool = False) -> list[tuple[str, int]]:
        """Check a project and build the layers that changed since it was last loaded, by this or an earlier session; returns those built."""
        p.check()
        kept = None if force else load_document(self.spark, f"{self.folder}/projects", p.name)  # not the project, which may have changed since
        todo = stale_layers(kept, p)
        self.project = p
        self._tiles.clear()
        self._layers.clear()
        self._held.clear()
        built = set()
        for canvas, i in todo:
            layer = p.canvases[canvas].layers[i]
            if layer.indexer == "pyramid":
                if layer.detail[1] not in built:  # all levels of a pyramid are built together
                    built.add(layer.detail[1])
                    self._build_pyramid(layer)
            else:
                self.build(canvas, i)
        save_document(self.spark, f"{self.folder}/projects", p.name, fingerprints(p))
        return todo

    def path(self, canvas: str, i: int) -> str:
        return f"{self.folder}/{self.project.name}/{canvas}/layer{i}"

    def build(self, canvas: str, i: int) -> None:
        c = self.project.canvases[canvas]
        layer = c.layers[i]
        if layer.transform is None or layer.indexer in ("chart", "sample"):  # answered from the source
            return
        rows = layer.transform.rows(self.spark)
        if layer.transform.function:  # a layer's rows are read for their number, for its borders and to be written
            rows = made = materialize(rows)
        else:
            made = None
        if layer.indexer == "numbered":
            t = layer.detail[0]
            rows = tables.cell_position(tables.number_rows(rows, list(t.fields), t.order, list(t.group_by)), t.cell_height, t.heads_height, 0)
        placed = place(rows, layer.placement, layer.static)
        if layer.static:
            manifest.save_table(placed, self.path(canvas, i), layout="static", side=0)
        else:
            self._write(canvas, i, placed, *self.size(canvas))
        if made is not None:
            discard(made)

    def _write(self, canvas: str, i: int, placed: DataFrame, w: float, h: float) -> None:
        layer = self.project.canvases[canvas].layers[i]
        layout = "tile" if layer.fetching == "tiling" and layer.layout == "box" and not layer.updates else layer.layout
        layouts.write(placed, self.path(canvas, i), Box(0, 0, max(w, 1), max(h, 1)), layout)

    def _build_pyramid(self, layer: Layer) -> None:
        """Clusters of every level with the columns of their heads, aggregates, hulls and first members; value ranges go to a document."""
        t, name, _ = layer.detail
        spec = t.spec
        rows = materialize(layer.transform.rows(self.spark))
        made = pyramid.build_pyramid(rows, spec)
        aggs = materialize(made.aggregates)
        measures, dimensions = list(spec.measures), list(spec.dimensions)
        keys = pyramid.cluster_keys(aggs, dimensions, measures, list(t.functions))
        top = made.top.groupBy("level", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda e: e["id"]).alias("top"))
        told = keys.join(made.hulls, ["level", "head"]).join(top, ["level", "head"])
        heads = made.levels.select("level", F.col("id").alias("head"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        clusters = materialize(heads.join(told, ["level", "head"]).join(rows, F.col("head") == F.col(spec.id).cast("long")))
        ranges = {str(r["level"]): {k: v for k, v in r.asDict().items() if k != "level"} for r in pyramid.measure_ranges(aggs, measures).collect()}  # one row a level
        save_document(self.spark, f"{self.folder}/pyramids", f"{self.project.name}/{name}", {"ranges": ranges, "levels": spec.levels, "theta": spec.distance, "mode": t.mode})
        for canvas, c in self.project.canvases.items():
            for i, one in enumerate(c.layers):
                if one.indexer == "pyramid" and one.detail[1] == name:
                    own = clusters.where(F.col("level") == one.detail[2]).drop("level", "head")
                    self._write(canvas, i, place(own, one.placement), c.w, c.h)
        made.release()
        discard(rows, aggs, clusters)

    def pyramid_information(self, canvas: str, i: int) -> dict:
        """What the build of a pyramid kept: value ranges of each level, number of levels, theta, mode."""
        return load_document(self.spark, f"{self.folder}/pyramids", f"{self.project.name}/{self.project.canvases[canvas].layers[i].detail[1]}")

    # reading

    def written(self, canvas: str, i: int) -> layouts.Written:
        if (canvas, i) not in self._layers:
            self._layers[canvas, i] = layouts.Written(self.spark, self.path(canvas, i))
        return self._layers[canvas, i]

    def layer(self, canvas: str, i: int) -> DataFrame:
        """Every row of a layer once."""
        w = self.written(canvas, i)
        return w.stored if w.layout == "static" else w.rows()

    def predicate(self, canvas: str, i: int, wire: str) -> Predicate:
        t = self.project.canvases[canvas].layers[i].transform
        return parse_wire(wire, t.filter_columns([] if t.filterable or t.columns else self._columns(canvas, i)))

    def _columns(self, canvas: str, i: int) -> list[str]:
        layer = self.project.canvases[canvas].layers[i]
        return layer.transform.rows(self.spark).columns if layer.indexer in ("chart", "sample") else self.layer(canvas, i).columns

    def _run(self, df: DataFrame) -> tuple[DataFrame, int]:
        out = self._keep(df)
        return out, out.count()

    def _keep(self, df: DataFrame) -> DataFrame:
        """Run a fetch and keep its rows, as long as a view holds them or few fetches have followed."""
        out = materialize(df)
        self._made.append(out)
        held = {id(t) for _, state in self._held.values() for t in state.values()}
        for _ in range(len(self._made) - KEPT_FETCHES):
            old = self._made.popleft()
            if id(old) in held:
                self._made.append(old)
            else:
                discard(old)
        return out

    # fetching

    def dynamic_box(self, canvas: str, mx: float, my: float, view: str, predicates: dict[int, Predicate] | None = None, old: Box | None = None, kind: str = "pan") -> tuple[Box, dict[int, DataFrame]]:
        """The box around a viewport and the rows of each dynamic, untiled layer; only what the old box lacks for delta layers."""
        began, total = time.time(), 0
        c, v = self.project.canvases[canvas], self.project.views[view]
        w, h = self.size(canvas, predicates)
        box = viewport.dynamic_box(mx, my, v.width, v.height, w, h)
        out = {}
        for i, layer in enumerate(c.layers):
            if layer.static or layer.fetching == "tiling" or layer.transform is None:
                continue
            rows = self.written(canvas, i).added(box, old if layer.delta else None)
            out[i], n = self._run(rows.where(to_column((predicates or {}).get(i, Everything()))))
            total += n
        self._note(canvas, kind, began, total)
        return box, out

    def pan(self, canvas: str, mx: float, my: float, view: str, kind: str = "pan") -> dict[int, DataFrame]:
        """Client state after a pan: fetched only near the edge of what is held, without duplicates. A state can be read until KEPT_FETCHES further ones."""
        v = self.project.views[view]
        key = (canvas, view)
        self._at[view] = (canvas, mx, my)
        held = self._held.get(key)
        if held is not None and not viewport.needs_fetch(mx, my, v.width, v.height, held[0], *self.size(canvas, self._predicates.get(key))):
            return held[1]
        box, new = self.dynamic_box(canvas, mx, my, view, self._predicates.get(key), old=held[0] if held else None, kind=kind)
        layers = self.project.canvases[canvas].layers
        state = {i: (self._keep(viewport.incremental(df, held[1][i], box)) if held and layers[i].delta else df) for i, df in new.items()}
        self._held[key] = (box, state)
        self._fire("pan", canvas)
        return state

    def tile(self, canvas: str, x: int, y: int, predicates: dict[int, Predicate] | None = None) -> dict:
        """Arrow tables of the tiled layers of a tile at pixel (x, y); the last few tiles are kept."""
        tx, ty = viewport.check_tile(x, y)
        if canvas not in self.project.canvases:
            raise ValueError(f"no canvas {canvas!r}")
        key = (self.project.name, canvas, x, y, repr(predicates))
        if key in self._tiles:
            self._tiles.move_to_end(key)
            return self._tiles[key]
        began, out = time.time(), {}
        for i, layer in enumerate(self.project.canvases[canvas].layers):
            if not layer.static and layer.fetching == "tiling":
                w = self.written(canvas, i)
                rows = w.tile(tx, ty) if w.layout == "tile" else w.in_box(Box(x, y, x + viewport.TILE, y + viewport.TILE))
                out[i] = rows.where(to_column((predicates or {}).get(i, Everything()))).toArrow()
        self._note(canvas, "tile", began, sum(t.num_rows for t in out.values()))
        self._tiles[key] = out
        if len(self._tiles) > CACHED_TILES:
            self._tiles.popitem(last=False)
        return out

    def static_layer(self, canvas: str, i: int, p: Predicate | None = None) -> DataFrame:
        """Rows of a static layer under a predicate. Charts and samples are aggregated from their source; the predicate holds before that."""
        layer, p = self.project.canvases[canvas].layers[i], p or Everything()
        if layer.transform is None:
            return self.spark.createDataFrame([], "id long")
        if layer.indexer not in ("chart", "sample"):
            return self.layer(canvas, i).where(to_column(p))
        t = layer.detail[0]
        check_columns(p, t.filterable())
        rows = layer.transform.rows(self.spark)
        if layer.indexer == "chart":
            return charts.chart(rows, t.kind, list(t.dimensions), t.measure, list(t.stack), to_column(p))
        return charts.sample_layer(rows, [*t.dimensions, *t.stack, *t.sample], list(t.sample), to_column(p))

    def canvas(self, canvas: str, predicates: dict[int, Predicate] | None = None) -> tuple[tuple[float, float], dict[int, DataFrame]]:
        """Size of a canvas and the rows of its static layers under the predicates of these layers."""
        began, total, out = time.time(), 0, {}
        for i, layer in enumerate(self.project.canvases[canvas].layers):
            if layer.static and layer.transform is not None:
                out[i], n = self._run(self.static_layer(canvas, i, (predicates or {}).get(i)))
                total += n
        self._note(canvas, "static", began, total)
        return self.size(canvas, predicates), out

    def size(self, canvas: str, predicates: dict[int, Predicate] | None = None) -> tuple[float, float]:
        """Width and height; where they depend on rows, on those that fit the checked predicate of the layer they go by."""
        c = self.project.canvases[canvas]

        def run(q) -> float:
            p = (predicates or {}).get(q.layer, Everything())
            rows = self.spark.sql(q.query)
            check_columns(p, list(q.filterable) or rows.columns)
            return float(rows.where(to_column(p)).agg(F.expr(q.value)).first()[0] or 0)

        return (float(c.w) if c.w > 0 else run(c.w_query)), (float(c.h) if c.h > 0 else run(c.h_query))

    def centroid(self, canvas: str, i: int, p: Predicate) -> tuple[float, float]:
        return navigation.centroid(self.layer(canvas, i), p)

    def first(self, view: str) -> dict:
        """What a client needs to begin: canvases and jumps, and the view's first canvas, viewport and rows."""
        v, p = self.project.views[view], self.project
        self._predicates[v.initial_canvas, view] = {int(k.removeprefix("layer")): from_json(tree) for k, tree in v.initial_predicates.items()}
        rows = self.pan(v.initial_canvas, v.initial_x, v.initial_y, view)
        return {"name": p.name, "canvases": {n: self.size(n, self._predicates.get((n, view))) if c.fixed or n == v.initial_canvas else None for n, c in p.canvases.items()}, "jumps": [(j.source, j.dest, j.type) for j in p.jumps], "canvas": v.initial_canvas, "viewport": (v.initial_x, v.initial_y), "rows": rows}

    # moving

    def jump(self, j: Jump, view: str, row: dict) -> navigation.Target:
        self._fire("jumpstart", j.source)
        t = navigation.follow(self.project, j, self.project.views[view], row, lambda i, p: self.centroid(j.dest, i, p))
        self._fire("jumpend", t.canvas)
        return t

    def trigger_jump(self, j: Jump, view: str, row: dict) -> dict[int, DataFrame]:
        """Follow a jump. A load goes to the view that the jump names; a highlight marks the rows held there; a slide moves by one viewport;
        other jumps take the view itself along. Without a viewport the corner stays where it is."""
        t = self.jump(j, view, row)
        if j.type == "highlight":
            held = self.render_data(t.canvas, j.dest_view)
            return {i: navigation.highlight(df, t.predicates[i]) for i, df in held.items()}
        dest = j.dest_view or view if j.type == "load" else view
        self._predicates[(t.canvas, dest)] = dict(enumerate(t.predicates))
        self._held.pop((t.canvas, dest), None)
        corner = t.corner or self._at.get(dest, ("", 0.0, 0.0))[1:]
        if j.type == "slide" and t.corner is None:
            v = self.project.views[dest]
            corner = navigation.slide(corner, (v.width, v.height), j.slide_direction)
        return self.pan(t.canvas, *corner, dest, "jump")

    def zoom(self, view: str, inward: bool, at: tuple[float, float] | None = None) -> dict[int, DataFrame]:
        """Literal zoom of a view: the point `at` of the viewport (its middle, if none is given) stays where it is."""
        canvas, x, y = self._at[view]
        v, kind = self.project.views[view], LITERAL_IN if inward else LITERAL_OUT
        j = next((j for j in self.project.jumps if j.source == canvas and j.type == kind), None)
        if j is None:
            raise ValueError(f"no {kind} from {canvas!r}")
        a, b = self.project.canvases[canvas], self.project.canvases[j.dest]
        px, py = at or (v.width / 2, v.height / 2)
        corner = ((x + px) * b.w / a.w - px, (y + py) * b.h / a.h - py)
        corner = tuple(min(max(0.0, c), max(0.0, whole - part)) for c, whole, part in zip(corner, (b.w, b.h), (v.width, v.height)))
        self._held.pop((j.dest, view), None)
        self._fire("zoom", j.dest)
        return self.pan(j.dest, *corner, view, "jump")

    # changing

    def update(self, canvas: str, i: int, changes: DataFrame, keys: list[str]) -> int:
        """Change rows of a layer by key, and those of the base table where the transform names one; the number of files of the layer rewritten.

        Columns of the base come from the transform's reverse functions or have the layer's names. Other levels are rebuilt by load(force=True).
        """
        layer = self.project.canvases[canvas].layers[i]
        if not layer.updates:
            raise ValueError("this layer takes no updates")
        began = time.time()
        w = self.written(canvas, i)
        if w.layout == "grid":
            raise ValueError("packed layers take no updates")
        changes = materialize(changes)
        n = manifest.change_table(self.spark, w.path, lambda df: df.join(changes.select(*keys).distinct(), keys, "left_semi"), lambda df: mutations.update_rows(df, changes, keys))
        if layer.transform.base:
            name, path = layer.transform.base
            base = self.spark.read.parquet(path)
            back = changes.select(*keys, *[f(changes).alias(c) for c, f in layer.transform.reverse.items() if c not in keys], *[c for c in mutations.changed_columns(changes.columns, base) if c not in keys and c not in layer.transform.reverse])
            mutations.rewrite(self.spark, path, lambda df: mutations.update_rows(df, back, keys))
            self.spark.read.parquet(path).createOrReplaceTempView(name)
        self._layers.pop((canvas, i), None)
        self._tiles.clear()
        self._held.clear()
        self._note(canvas, "update", began, changes.count())
        return n

    def close(self) -> None:
        """Write what is left of the log and delete the tables of all fetches."""
        self.flush_log()
        self._held.clear()
        discard(*self._made)
        self._made.clear()

    # embedding

    def render_data(self, canvas: str, view: str) -> dict[int, DataFrame]:
        held = self._held.get((canvas, view))
        return held[1] if held else {}

    def object_data(self, canvas: str, view: str, i: int, p: Predicate | None = None) -> DataFrame:
        return self.render_data(canvas, view)[i].where(to_column(p or Everything())).dropDuplicates()

    def trigger_predicate(self, canvas: str, view: str, predicates: dict[int, str]) -> dict[int, DataFrame]:
        """Load a view again under predicates in wire form, one a layer; layers not named keep everything."""
        self._predicates[(canvas, view)] = {i: self.predicate(canvas, i, w) for i, w in predicates.items()}
        return self.re_render(view)

    def trigger_pan(self, view: str, x: float, y: float) -> dict[int, DataFrame]:
        return self.pan(self._at[view][0], x, y, view)

    def re_render(self, view: str) -> dict[int, DataFrame]:
        """Fetch a view afresh."""
        canvas, x, y = self._at[view]
        self._held.pop((canvas, view), None)
        return self.pan(canvas, x, y, view)

    def on(self, event: str, f) -> None:
        if event not in EVENTS:
            raise ValueError(f"unknown event {event!r}")
        self._listeners.setdefault(event, []).append(f)

    def _fire(self, event: str, canvas: str) -> None:
        for f in self._listeners.get(event, []):
            f(canvas)

    def _note(self, canvas: str, kind: str, began: float, rows: int) -> None:
        if self.log:
            self._entries.append((self.project.name, canvas, kind, (time.time() - began) * 1000, rows))
            if len(self._entries) >= 100:
                self.flush_log()

    def flush_log(self) -> None:
        if self._entries:
            log_fetch(self.spark, f"{self.folder}/stats", self._entries)
            self._entries = []


def opacity_by(df: DataFrame, condition) -> DataFrame:
    """Rows dimmed where a condition fails."""
    return df.withColumn("opacity", F.when(condition, 1.0).otherwise(0.4))
