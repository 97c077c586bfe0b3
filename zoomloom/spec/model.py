"""Specifications: projects, views, canvases, layers, jumps; validation at construction and at save."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import json
import re
import types
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from zoomloom.operators.placement import Placement

LITERAL_IN, LITERAL_OUT = "literal_zoom_in", "literal_zoom_out"
JUMP_TYPES = (LITERAL_IN, LITERAL_OUT, "semantic_zoom", "geometric_semantic_zoom", "load", "highlight", "slide")


class SpecError(ValueError):
    """A specification that cannot work."""


@dataclass(frozen=True)
class View:
    id: str
    width: int
    height: int
    initial_canvas: str = ""
    initial_x: float = 0.0
    initial_y: float = 0.0
    initial_predicates: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise SpecError("a view has a positive size")


@dataclass(frozen=True)
class Transform:
    """A query and a function DataFrame -> DataFrame; columns are declared where a function is given, else inferred.

    base is (table name, Parquet path) of the table that updates of the layer are written back to; reverse maps its columns to functions of the
    layer's columns.
    """

    query: str = ""
    function: Callable[[DataFrame], DataFrame] | None = None
    columns: tuple[str, ...] = ()
    filterable: tuple[str, ...] = ()
    reverse: dict[str, Callable] = field(default_factory=dict)
    separable: bool = True
    base: tuple[str, str] | None = None

    def __post_init__(self):
        if self.function is not None and not self.columns:
            raise SpecError("a transform with a function declares its columns")
        if not isinstance(self.separable, bool):
            raise SpecError("separable is a boolean")
        if not set(self.filterable) <= set(self.columns or self.filterable):
            raise SpecError("a filterable column is a column of the transform")

    def filter_columns(self, inferred: list[str]) -> list[str]:
        return list(self.filterable or self.columns or inferred)

    def rows(self, spark) -> DataFrame:
        df = spark.sql(self.query.rstrip("; \n\t"))
        return self.function(df) if self.function else df


_NAME = re.compile(r"[A-Za-z_]\w*")


def computed(source: str, results: dict[str, str], **more) -> Transform:
    """A transform by expressions: each result column is a SQL expression over the columns of a table, or of a SELECT."""
    source = source.strip().rstrip("; \n\t")
    if not re.match(r"SELECT\s", source, re.I) and not re.fullmatch(rf"({_NAME.pattern}\.)?{_NAME.pattern}", source):
        raise SpecError(f"{source!r} is no SELECT and no name of a table")
    if not results:
        raise SpecError("a transform by expressions names its results")
    for name, expression in results.items():
        if not _NAME.fullmatch(name):
            raise SpecError(f"bad name of a column {name!r}")
        if ";" in expression or not _NAME.search(re.sub(r"'[^']*'", "", expression)):
            raise SpecError(f"{name!r} is not computed from any column")
    if len({n.lower() for n in results}) < len(results):
        raise SpecError("two results of one name")
    rows = f"({source})" if " " in source else source
    return Transform(query="SELECT " + ", ".join(f"{e} AS {n}" for n, e in results.items()) + f" FROM {rows}", columns=tuple(results), **more)


@dataclass(frozen=True)
class Layer:
    transform: Transform | None
    static: bool = False
    placement: Placement | None = None
    fetching: str = "dbox"
    delta: bool = True
    indexer: str = "box"
    updates: bool = False
    layout: str = "box"
    detail: tuple = ()
    tooltip: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.static and self.transform is None:
            raise SpecError("a dynamic layer needs a transform")
        if self.fetching not in ("dbox", "tiling"):
            raise SpecError("fetching is dbox or tiling")
        if self.indexer not in ("box", "pyramid", "numbered", "chart", "sample"):
            raise SpecError(f"unknown indexer {self.indexer!r}")
        if self.layout not in ("box", "tile", "grid", "strip", "slab"):
            raise SpecError(f"unknown layout {self.layout!r}")
        if self.static and self.fetching == "tiling":
            raise SpecError("a static layer is not tiled")
        if self.aliases and len(self.aliases) != len(self.tooltip):
            raise SpecError("as many tooltip aliases as columns")


@dataclass(frozen=True)
class SizeQuery:
    """A size that depends on the rows: an aggregate expression over a query, after the predicate of the layer that it goes by."""

    query: str
    value: str
    layer: int = 0
    filterable: tuple[str, ...] = ()


@dataclass(frozen=True)
class Canvas:
    """Width and height are fixed, or 0 with a SizeQuery."""

    id: str
    w: int
    h: int
    layers: tuple[Layer, ...] = ()
    w_query: SizeQuery | None = None
    h_query: SizeQuery | None = None

    def __post_init__(self):
        if (self.w <= 0 and not self.w_query) or (self.h <= 0 and not self.h_query):
            raise SpecError("a canvas has a positive size or a size query")

    @property
    def fixed(self) -> bool:
        return self.w > 0 and self.h > 0


@dataclass(frozen=True)
class Jump:
    source: str
    dest: str
    type: str
    selector: Callable | None = None
    predicates: Callable | None = None
    viewport: Callable | None = None
    name: Callable | str | None = None
    slide_direction: float | None = None
    source_view: str = ""
    dest_view: str = ""

    def __post_init__(self):
        if self.type not in JUMP_TYPES:
            raise SpecError(f"unknown jump type {self.type!r}")
        if self.type in (LITERAL_IN, LITERAL_OUT) and (self.selector or self.predicates or self.viewport):
            raise SpecError("a literal zoom takes no functions")
        if self.type in ("load", "highlight") and not (self.source_view and self.dest_view):
            raise SpecError(f"a {self.type} jump names its views")
        if self.type == "load" and not self.viewport:
            raise SpecError("a load jump gives a viewport")
        if self.type == "slide" and (self.slide_direction is None or not 0 <= self.slide_direction < 360):
            raise SpecError("a slide goes in a direction from 0 to below 360")


@dataclass
class Project:
    name: str
    views: dict[str, View] = field(default_factory=dict)
    canvases: dict[str, Canvas] = field(default_factory=dict)
    jumps: list[Jump] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def add_view(self, v: View) -> View:
        if v.id in self.views:
            raise SpecError(f"view {v.id!r} is there already")
        self.views[v.id] = v
        return v

    def add_canvas(self, c: Canvas) -> Canvas:
        if c.id in self.canvases:
            raise SpecError(f"canvas {c.id!r} is there already")
        self.canvases[c.id] = c
        return c

    def add_jump(self, j: Jump) -> Jump:
        for end in (j.source, j.dest):
            if end not in self.canvases:
                raise SpecError(f"no canvas {end!r}")
        if j.type in (LITERAL_IN, LITERAL_OUT):
            if any(k.source == j.source and k.type == j.type for k in self.jumps):
                raise SpecError("one literal zoom of a kind for a canvas")
            zoom_factor(self.canvases[j.source], self.canvases[j.dest], j.type)
        self.jumps.append(j)
        return j

    def check(self) -> None:
        """The rules that hold for a whole project."""
        if not self.views:
            raise SpecError("a project has a view")
        for c in self.canvases.values():
            if not c.layers:
                raise SpecError(f"canvas {c.id!r} has no layer")
            for layer in c.layers:
                if layer.static and layer.placement:
                    raise SpecError("a static layer has no placement")
                if not layer.static and not layer.placement:
                    raise SpecError("a dynamic layer has a placement")
                known = layer.transform.columns if layer.transform else ()
                if known and layer.placement and not set(layer.placement.columns()) <= set(known):
                    raise SpecError("placement columns come from the transform")
        for v in self.views.values():
            c = self.canvases.get(v.initial_canvas)
            if c is None:
                raise SpecError(f"view {v.id!r} starts on no canvas")
            if c.fixed and (c.w < v.width or c.h < v.height):
                raise SpecError("a canvas is not smaller than its view")
            if c.fixed and not (0 <= v.initial_x <= c.w - v.width and 0 <= v.initial_y <= c.h - v.height):
                raise SpecError("the first viewport lies inside the canvas")
        zoom_levels(self)


def zoom_factor(a: Canvas, b: Canvas, kind: str) -> float:
    """Size of the target over that of the source; both axes agree to 1e-3, in is above 1 and out below."""
    if not (a.fixed and b.fixed):
        raise SpecError("a literal zoom joins canvases of fixed size")
    fx, fy = b.w / a.w, b.h / a.h
    if abs(fx - fy) > 1e-3:
        raise SpecError("both axes zoom alike")
    if (kind == LITERAL_IN) != (fx > 1) or fx == 1:
        raise SpecError("zooming in enlarges, zooming out shrinks")
    return fx


def zoom_levels(p: Project) -> dict[str, int]:
    """Level of each canvas in its chain of literal zooms, 0 at the top."""
    below = {j.source: j.dest for j in p.jumps if j.type == LITERAL_IN}
    above = {j.source: j.dest for j in p.jumps if j.type == LITERAL_OUT}
    for a, b in below.items():
        if b in above and above[b] != a:
            raise SpecError("zooming out leads back where zooming in came from")
    reached = set(below.values())
    out = {}
    for c in p.canvases:
        if c in reached:
            continue
        level, at, seen = 0, c, set()
        while at is not None and at not in seen:
            seen.add(at)
            out[at] = level
            at, level = below.get(at), level + 1
    if len(out) < len(p.canvases):
        raise SpecError("literal zooms form a circle")
    return out


def told_value(v, seen: set[int] | None = None):
    """What a captured or global value contributes to a fingerprint: plain values themselves, functions their code, others their type."""
    if v is None or isinstance(v, (bool, int, float, complex, str, bytes)):
        return repr(v)
    if isinstance(v, (tuple, list)):
        return [told_value(x, seen) for x in v]
    if isinstance(v, (set, frozenset)):
        return sorted(str(told_value(x, seen)) for x in v)
    if isinstance(v, dict):
        return sorted((repr(k), str(told_value(x, seen))) for k, x in v.items())
    if isinstance(v, functools.partial):
        return ["partial", told_value(v.func, seen), told_value(v.args, seen), told_value(v.keywords, seen)]
    if isinstance(v, types.CodeType):
        return [v.co_code.hex(), list(v.co_names), list(v.co_varnames), [told_value(c, seen) for c in v.co_consts]]
    if dataclasses.is_dataclass(v) and not isinstance(v, type):
        return [type(v).__qualname__, *[[f.name, told_value(getattr(v, f.name), seen)] for f in dataclasses.fields(v)]]
    if isinstance(v, types.MethodType):
        return ["method", told_value(v.__func__, seen)]
    if isinstance(v, types.FunctionType):
        return told_function(v, seen)
    return getattr(v, "__qualname__", None) or getattr(v, "__name__", None) or type(v).__qualname__


def told_function(f: types.FunctionType, seen: set[int] | None = None):
    """Code, names, constants, defaults, captured values and the globals that a function reads, functions among them told alike."""
    seen = seen if seen is not None else set()
    if id(f) in seen:
        return f.__qualname__
    seen.add(id(f))
    names: set[str] = set()
    todo = [f.__code__]
    while todo:
        c = todo.pop()
        names |= set(c.co_names)
        todo += [x for x in c.co_consts if isinstance(x, types.CodeType)]
    cells = []
    for c in f.__closure__ or ():
        try:
            cells.append(told_value(c.cell_contents, seen))
        except ValueError:  # not filled yet
            cells.append("empty")
    read = [[n, told_value(f.__globals__[n], seen)] for n in sorted(names) if n in f.__globals__]
    return [told_value(f.__code__, seen), told_value(f.__defaults__, seen), told_value(f.__kwdefaults__, seen), cells, read]


def fingerprint(c: Canvas, i: int, params: dict) -> str:
    """Changes when a layer's index must be built again: size, layer count, static flag, placement, layout, transform, template, parameters."""
    layer = c.layers[i]
    t = layer.transform
    own = (t.query, list(t.columns), told_value(t.function)) if t else None
    parts = [c.id, c.w, c.h, told_value(c.w_query), told_value(c.h_query), len(c.layers), i, layer.static, told_value(layer.placement), layer.indexer, layer.layout, layer.fetching, told_value(layer.detail), own, told_value(params)]
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def fingerprints(p: Project) -> dict[str, str]:
    """One for each layer, under 'canvas/layer'."""
    return {f"{c.id}/{i}": fingerprint(c, i, p.params) for c in p.canvases.values() for i in range(len(c.layers))}


def stale_layers(old: Project | dict[str, str] | None, new: Project) -> list[tuple[str, int]]:
    """(canvas, layer) whose index must be built; old is a project or the fingerprints kept of it."""
    before = fingerprints(old) if isinstance(old, Project) else old or {}
    return [(c.id, i) for c in new.canvases.values() for i in range(len(c.layers)) if before.get(f"{c.id}/{i}") != fingerprint(c, i, new.params)]
