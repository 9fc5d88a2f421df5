"""Views: declarative descriptors of a query, its geometry, channels, measures and encoding."""
from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from .functions.measures import Expr, MeasureError, dimensions, inner_of, parse
from .sources import files

VIEWPORTS = ("geo", "orthographic")
MARKS = ("point", "line", "arc", "rect", "polygon", "heat", "text")
AREA_MARKS = ("polygon", "rect", "heat")
GEOMETRIES = ("xy", "lonLat", "quadkey", "wkt", "geohash", "h3")
ROLES = ("measure", "dimension", "temporal", "identity")
TYPES = ("f32", "f64", "u8", "u16", "i32", "i64", "dict", "date")
NUMERIC = ("f32", "f64", "u8", "u16", "i32", "i64")
CONTROLS = ("select", "multiSelect", "dateRange", "range")
_ID = re.compile(r"[a-z0-9-]+\Z")


class ViewError(ValueError):
    """The view cannot be baked as declared."""


@dataclass(frozen=True)
class Channel:
    name: str
    column: str
    role: str
    type: str


@dataclass(frozen=True)
class Geometry:
    kind: str
    column: str | None = None
    x: str | None = None
    y: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    expr: str

    @property
    def tree(self) -> Expr:
        return parse(self.expr)


@dataclass(frozen=True)
class View:
    id: str
    query: str
    geometry: Geometry
    channels: tuple[Channel, ...] = ()
    title: str = ""
    viewport: str = "geo"
    mark: str = "point"
    adapter: str = "sql"
    bake_filters: tuple[str, ...] = ()
    filters: tuple[dict, ...] = ()
    measures: tuple[Measure, ...] = ()
    aggregate: dict | None = None
    storage: dict = field(default_factory=dict)
    encoding: dict = field(default_factory=dict)
    inspect: dict | None = None

    @property
    def grouped(self) -> bool:
        """Facts are grouped to marks exactly when there are measures."""
        return bool(self.measures)

    def channel(self, name: str) -> Channel | None:
        return next((c for c in self.channels if c.name == name), None)

    @property
    def dictionaries(self) -> list[str]:
        return [c.name for c in self.channels if c.type == "dict" and c.role != "identity"]

    @property
    def color(self) -> str | None:
        return (self.encoding.get("color") or {}).get("channel")

    def faults(self):
        """Every rule the view breaks, in words."""
        g, declared = self.geometry, Counter(c.name for c in self.channels)
        by_type = lambda *types: {c.name for c in self.channels if c.type in types}
        trees, unreadable = {}, []
        for m in self.measures:
            try:
                trees[m.name] = m.tree
            except MeasureError as e:
                unreadable.append(f"measure '{m.name}' cannot be read: {e}")
        showable = {*declared, *(m.name for m in self.measures)}
        color, size = self.encoding.get("color") or {}, self.encoding.get("size") or {}
        shown = [] if self.inspect is None else [*(self.inspect.get("channels") or []), *filter(None, [self.inspect.get("title")])]
        places = (g.x, g.y) if g.kind in ("xy", "lonLat") else (g.column,)
        rules = {
            "ids are kebab-case: letters a-z, digits and hyphens": [] if _ID.match(self.id or "") else [self.id],
            "a source needs a query": [] if (self.query or "").strip() else ["source"],
            "no such kind of geometry, viewport or mark": [x for x, known in ((g.kind, GEOMETRIES), (self.viewport, VIEWPORTS), (self.mark, MARKS)) if x not in known],
            "the geometry does not say its columns": [] if all(places) else [g.kind],
            "role or type is unknown": [c.name for c in self.channels if c.role not in ROLES or c.type not in TYPES],
            "two channels or measures share a name": [n for n, k in (declared + Counter(m.name for m in self.measures)).items() if k > 1],
            "measures need a name": ["measures"] if any(not (m.name or "").strip() for m in self.measures) else [],
            "only keyed places (quadkey) can be measured": [g.kind] if self.measures and g.kind != "quadkey" else [],
            "sums and averages need a number": [c for t in trees.values() for c in (inner_of(t).channel, inner_of(t).weight) if c and c not in by_type(*NUMERIC)],
            "restrictions and arg measures need a dict": [c for t in trees.values() for c in dimensions(t) if c not in by_type("dict")],
            "color shows no channel or measure of the view": [c for c in [color.get("channel")] if c and c not in showable],
            "color needs one bin at least": [] if color.get("bins") is None or color["bins"] > 0 else [color["bins"]],
            "size shows no channel of the view": [c for c in [size.get("channel")] if c and c not in declared],
            "inspect shows nothing": ["inspect"] if self.inspect is not None and not self.inspect.get("channels") else [],
            "inspect shows no channel or measure of the view": [c for c in shown if c not in showable],
            "filters need a channel of the view and a known control": [f.get("channel") for f in self.filters if isinstance(f, dict) and (f.get("channel") not in declared or f.get("control", "select") not in CONTROLS)],
            "aggregate groups by channels of the view": [c for c in (self.aggregate or {}).get("by", []) if c not in declared],
        }
        return unreadable + [f"{rule}: {', '.join(map(repr, broken))}" for rule, broken in rules.items() if broken]

    def validate(self) -> View:
        if found := self.faults():
            raise ViewError(f"view '{self.id}': {'; '.join(found)}")
        return self

    def validate_classified(self, per_fact: set[str]) -> None:
        """Rules that need the data: dimensions of arg and where vary within marks; raw per-fact channels can't be inspected."""
        for m in self.measures:
            tree = m.tree
            dims = set(dimensions(tree))
            if flat := dims - per_fact:
                raise ViewError(f"view '{self.id}': measure '{m.name}': '{flat.pop()}' is constant within every mark")
        for name in (self.inspect or {}).get("channels", []) if self.grouped else []:
            if name in per_fact:
                raise ViewError(f"view '{self.id}': inspect channel '{name}' varies within marks; use a measure")


def _relaxed(text: str) -> Any:
    """JSON with // and /* */ comments and trailing commas; strings are left alone."""
    keep = r'("(?:[^"\\]|\\.)*")'
    text = re.sub(keep + r"|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(keep + r"|,(?=\s*[}\]])", lambda m: m[1] or "", text))


def _lowered(x: Any) -> Any:
    """Property names are case-insensitive in their first letter."""
    return {k[:1].lower() + k[1:]: _lowered(v) for k, v in x.items()} if isinstance(x, dict) else [_lowered(v) for v in x] if isinstance(x, list) else x


def load_view(text: str) -> View:
    d = _lowered(_relaxed(text))
    source = d.get("source") or {}
    g = source.get("geometry") or {}
    return View(
        id=d.get("id", ""), title=d.get("title", ""), viewport=d.get("viewport", "geo"), mark=d.get("mark", "point"), query=source.get("query", ""), adapter=source.get("adapter", "sql"),
        geometry=Geometry(g.get("kind", ""), g.get("column"), g.get("x") or g.get("lon"), g.get("y") or g.get("lat")),
        channels=tuple(Channel(c["name"], c.get("column") or c["name"], c["role"], c["type"]) for c in source.get("channels") or []),
        bake_filters=tuple(f if isinstance(f, str) else f["predicate"] for f in d.get("bakeFilters") or []), filters=tuple(d.get("filters") or []),
        measures=tuple(Measure(m.get("name", ""), m.get("expr", "")) for m in d.get("measures") or []),
        aggregate=d.get("aggregate"), storage=d.get("storage") or {}, encoding=d.get("encoding") or {}, inspect=d.get("inspect"),
    ).validate()


def dump_view(v: View) -> str:
    drop = lambda d: {k: x for k, x in d.items() if x not in (None, (), [], {}, "")}
    source = drop({"adapter": v.adapter, "query": v.query, "geometry": drop(vars(v.geometry)), "channels": [vars(c) for c in v.channels]})
    return json.dumps(drop({"id": v.id, "title": v.title, "viewport": v.viewport, "mark": v.mark, "source": source, "bakeFilters": list(v.bake_filters), "filters": list(v.filters), "measures": [vars(m) for m in v.measures], "aggregate": v.aggregate, "storage": v.storage, "encoding": v.encoding, "inspect": v.inspect}), indent=2)


class ViewRegistry:
    """Views as JSON files of a folder, in any file system that Spark reads: list, get, save."""

    def __init__(self, folder: str):
        self.folder = folder

    def list(self) -> list[str]:
        return [f[:-5] for f in files.names(self.folder) if f.endswith(".json")]

    def get(self, view_id: str) -> View | None:
        text = files.read(f"{self.folder}/{view_id}.json") if _ID.match(view_id) else None
        return None if text is None else load_view(text)

    def save(self, view: View) -> None:
        view.validate()
        files.make(self.folder)
        files.write(f"{self.folder}/{view.id}.json", dump_view(view))
