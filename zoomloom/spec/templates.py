"""Templates: pyramids, tables, charts and maps, checked and expanded into canvases, layers that the engine builds, and jumps."""

from __future__ import annotations

import dataclasses
import math
import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from zoomloom.functions import geo
from zoomloom.operators.charts import LIMITS, MEASURE
from zoomloom.operators.placement import Placement
from zoomloom.operators.pyramid import FUNCTIONS, MODES, PyramidSpec
from zoomloom.spec.model import LITERAL_IN, LITERAL_OUT, Canvas, Jump, Layer, Project, SizeQuery, SpecError, Transform

NO_DIMENSIONS = ("radar", "circle", "heatmap", "contour", "dot")
ONE_MEASURE = ("circle", "heatmap", "contour", "pie")


@dataclass(frozen=True)
class PyramidTemplate:
    spec: PyramidSpec
    query: str
    mode: str = "circle"
    functions: tuple[str, ...] = ("count",)
    renderer: bool = False
    axis: bool = False
    geo: bool = False
    extent_given: bool = True
    rank_list: bool = False
    tooltip: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    radar_extents: tuple[tuple[float, float], ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "spec", dataclasses.replace(self.spec, mode=self.mode))
        s = self.spec
        if re.search(r"\blimit\b", self.query, re.I):
            raise SpecError("the query of a pyramid has no LIMIT")
        if self.mode not in MODES:
            raise SpecError(f"unknown mode {self.mode!r}")
        if self.mode in NO_DIMENSIONS and s.dimensions:
            raise SpecError(f"{self.mode} takes no dimensions")
        if self.mode in ONE_MEASURE and len(s.measures) > 1:
            raise SpecError(f"{self.mode} takes one measure")
        if self.mode == "pie" and not (s.dimensions and len(s.measures) <= 1):
            raise SpecError("pie takes dimensions and one measure")
        if self.mode == "radar" and len(self.radar_extents) != len(s.measures):
            raise SpecError("radar marks give an extent for each measure")
        if self.mode == "dot" and s.measures:
            raise SpecError("dot takes no measures")
        if self.mode == "custom" and not self.renderer:
            raise SpecError("custom marks need a renderer")
        if self.axis and not self.extent_given:
            raise SpecError("axes need extents")
        if self.geo and self.extent_given:
            raise SpecError("a map has no extents")
        if self.rank_list and self.tooltip:
            raise SpecError("either a rank list or a tooltip")
        if self.aliases and len(self.aliases) != len(self.tooltip):
            raise SpecError("as many aliases as tooltip columns")
        if not set(self.functions) <= set(FUNCTIONS):
            raise SpecError("unknown aggregate function")
        for side in (s.top_width, s.top_height):
            if not 200 <= side <= 4000:
                raise SpecError("the top level measures 200 to 4000")


def add_pyramid(p: Project, t: PyramidTemplate) -> list[Canvas]:
    """A canvas a level (a static legend and a dynamic layer of clusters each), joined by literal zooms."""
    s = t.spec
    name = f"pyramid{len(p.canvases)}"
    made = []
    for i in range(s.levels + 1):
        w, h = int(s.top_width * s.zoom**i), int(s.top_height * s.zoom**i)
        place = Placement("col:cx", "col:cy", f"con:{s.mark_w * s.distance}", f"con:{s.mark_h * s.distance}")
        layer = Layer(Transform(query=t.query), placement=place, delta=t.mode not in ("contour", "heatmap"), indexer="pyramid", detail=(t, name, i), tooltip=t.tooltip, aliases=t.aliases)
        made.append(p.add_canvas(Canvas(f"{name}_level{i}", w, h, (Layer(None, static=True), layer))))
    for a, b in zip(made, made[1:]):
        p.add_jump(Jump(a.id, b.id, LITERAL_IN))
        p.add_jump(Jump(b.id, a.id, LITERAL_OUT))
    return made


@dataclass(frozen=True)
class TableTemplate:
    table: str
    fields: tuple[str, ...]
    order: str
    widths: tuple[int, ...] = ()
    heads: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    cell_height: int = 40
    heads_height: int = 50

    def __post_init__(self):
        if not self.table or not self.fields:
            raise SpecError("a table names its source and fields")
        for what, given in (("widths", self.widths), ("heads", self.heads)):
            if given and len(given) != len(self.fields):
                raise SpecError(f"as many {what} as fields")
        if not self.order:
            raise SpecError("a numbered table needs an order")

    @property
    def width(self) -> int:
        return math.ceil(sum(self.widths)) if self.widths else 100 * len(self.fields)


def add_table(p: Project, t: TableTemplate) -> Canvas:
    """A canvas as wide as the columns, as high as the rows that fit the predicate; rows are numbered, within each group where groups are named."""
    size = SizeQuery(f"SELECT * FROM {t.table}", f"count(*) * {t.cell_height} + {t.heads_height}", 0, t.group_by or t.fields)
    layer = Layer(Transform(query=f"SELECT * FROM {t.table}", filterable=t.group_by), placement=Placement(f"con:{t.width / 2}", "col:cell_y", f"con:{t.width}", f"con:{t.cell_height}"), indexer="numbered", detail=(t,))
    return p.add_canvas(Canvas(f"table{len(p.canvases)}", t.width, 0, (layer,), h_query=size))


@dataclass(frozen=True)
class ChartTemplate:
    query: str
    kind: str
    dimensions: tuple[str, ...]
    measure: str
    stack: tuple[str, ...] = ()
    sample: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    tooltip: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in LIMITS:
            raise SpecError(f"unknown chart {self.kind!r}")
        if not MEASURE.match(self.measure):
            raise SpecError(f"bad measure {self.measure!r}")
        if self.stack and self.kind != "bar":
            raise SpecError("only bars are stacked")
        column = MEASURE.match(self.measure).group(2).strip()
        used = [*self.dimensions, *self.stack, *self.sample, *([column] if column != "*" else [])]
        if not self.tooltip:  # what the chart shows
            object.__setattr__(self, "tooltip", (*self.dimensions, "agg_value"))
            object.__setattr__(self, "aliases", self.aliases or (*self.dimensions, self.measure))
        if len(used) != len(set(used)):
            raise SpecError("the fields of a chart are disjoint")
        if not set(self.text) <= set(self.dimensions):
            raise SpecError("text fields are dimensions")
        if self.aliases and len(self.aliases) != len(self.tooltip):
            raise SpecError("as many aliases as tooltip columns")

    def filterable(self) -> list[str]:
        return [*self.dimensions, *self.stack, *self.sample]


def add_chart(p: Project, t: ChartTemplate, w: int = 1000, h: int = 1000) -> Canvas:
    """A static canvas: the chart layer, and the sample layer where sample fields are named."""
    source = Transform(query=t.query, filterable=tuple(t.filterable()))
    layers = [Layer(source, static=True, indexer="chart", detail=(t,))]
    if t.sample:
        layers.append(Layer(source, static=True, indexer="sample", detail=(t,)))
    return p.add_canvas(Canvas(f"chart{len(p.canvases)}", w, h, tuple(layers)))


@dataclass(frozen=True)
class MapTemplate:
    """Tables of states, and of counties, with columns name, the rate and geomstr (GeoJSON)."""

    state_table: str
    rate: str
    county_table: str = ""
    colors: int = 8
    zoom_factor: int | None = None
    zoom_type: str | None = None
    projection: str = "albers"
    name: str = "name"
    shape: str = "geomstr"

    def __post_init__(self):
        if not 2 <= self.colors <= 8:
            raise SpecError("a map has 2 to 8 colours")
        if not self.county_table and (self.zoom_factor is not None or self.zoom_type is not None):
            raise SpecError("zooming needs a county table")
        if self.zoom_type not in (None, "literal", "jump"):
            raise SpecError("zoom is literal or jump")
        if self.projection not in geo.PROJECTIONS:
            raise SpecError(f"unknown projection {self.projection!r}")


MAP_COLUMNS = ("cx", "cy", "width", "height", "name", "rate", "geomstr")


def add_map(p: Project, t: MapTemplate, w: int = 2000, h: int = 1000) -> list[Canvas]:
    """A state canvas and, with counties, a larger one joined by literal zooms or by jumps to a state, which then lies in the middle."""
    f = t.zoom_factor or 6

    def shapes(table: str, scale: int) -> Transform:
        def located(df):
            s = geo.geojson_shape(t.projection, w * scale, h * scale)
            return df.select(F.col(t.name).alias("name"), F.col(t.rate).alias("rate"), F.col(t.shape).alias("geomstr"), s(F.col(t.shape)).alias("s")).select("s.*", "name", "rate", "geomstr")

        return Transform(query=f"SELECT * FROM {table}", function=located, columns=MAP_COLUMNS)

    mark = Placement("col:cx", "col:cy", f"con:{w / f}", f"con:{w / f}")
    boxes = Placement("col:cx", "col:cy", "col:width", "col:height")
    made = [p.add_canvas(Canvas("state_map", w, h, (Layer(None, static=True), Layer(shapes(t.state_table, 1), placement=mark))))]
    if t.county_table:
        made.append(p.add_canvas(Canvas("county_map", w * f, h * f, (Layer(None, static=True), Layer(shapes(t.state_table, f), placement=boxes), Layer(shapes(t.county_table, f), placement=boxes)))))
        if (t.zoom_type or "literal") == "literal":
            p.add_jump(Jump("state_map", "county_map", LITERAL_IN))
            p.add_jump(Jump("county_map", "state_map", LITERAL_OUT))
        else:
            middle = lambda row: {"constant": (row["cx"] * f - w / 2, row["cy"] * f - h / 2)}
            p.add_jump(Jump("state_map", "county_map", "geometric_semantic_zoom", selector=lambda row, args: args.get("layer") == 1, viewport=middle))
    return made
