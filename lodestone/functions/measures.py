"""The measure grammar: text to expression tree, additive partials, and aggregate Columns.

    expr := agg [where channel = 'literal'] | share(agg) where channel = 'literal' | argmax(dim, agg) | argmin(dim, agg)
    agg  := sum(c) | count() | avg(c) | wavg(c, w) | min(c) | max(c)

Null rules of a fold: an empty inner set gives 0 for sum and count, null for avg, wavg, min and max; share of an empty
restriction is 0 and of an empty whole null; avg divides by the row count, nulls included.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VERBS = ("sum", "count", "avg", "wavg", "min", "max")
UNKNOWN_CODE = 65535


class MeasureError(ValueError):
    """The text is no measure; the message names what was expected and what was found."""


@dataclass(frozen=True)
class Where:
    channel: str
    value: str


@dataclass(frozen=True)
class Agg:
    verb: str
    channel: str | None = None
    weight: str | None = None
    where: Where | None = None


@dataclass(frozen=True)
class Share:
    inner: Agg
    where: Where


@dataclass(frozen=True)
class ArgExtreme:
    dimension: str
    inner: Agg
    largest: bool = True


Expr = Agg | Share | ArgExtreme

#: What stands between the brackets of a verb, and what the call becomes. `where` may follow (None), must, or must not.
GRAMMAR = {
    **{verb: (("number",) * {"count": 0, "wavg": 2}.get(verb, 1), None, lambda args, where, verb=verb: Agg(verb, *args, *(None,) * (2 - len(args)), where)) for verb in VERBS},
    "share": (("aggregate",), True, lambda args, where: Share(*args, where)),
    "argmax": (("dimension", "aggregate"), False, lambda args, where: ArgExtreme(*args, True)),
    "argmin": (("dimension", "aggregate"), False, lambda args, where: ArgExtreme(*args, False)),
}
#: What messages call the parts of a measure.
SAYS = {"number": "a numeric channel", "dimension": "a dimension channel", "aggregate": "an aggregate verb", "literal": "a quoted literal"}
_LEXEME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|'[^']*'|\S")
_KINDS = {"number": str.isidentifier, "dimension": str.isidentifier, "aggregate": str.isidentifier, "literal": lambda x: len(x) > 1 and x[0] == x[-1] == "'"}


def _expect(tokens: list[str], kind: str) -> str:
    """The next token, which must be of a kind of SAYS or else the very mark."""
    found = tokens[0] if tokens else ""
    if not (_KINDS[kind](found) if kind in SAYS else found == kind):
        wanted = SAYS.get(kind, f"'{kind}'")
        raise MeasureError(f"expected {wanted}, found '{found or 'end of expression'}'")
    return tokens.pop(0)


def _call(tokens: list[str], inside: bool = False) -> Expr:
    """One verb with its arguments and restriction, as its line of the grammar says. tokens: what is left; gets shorter."""
    if inside and tokens and tokens[0] in GRAMMAR.keys() - set(VERBS):
        raise MeasureError(f"expected {SAYS['aggregate']}, found '{tokens[0]}'")
    verb = _expect(tokens, "aggregate")
    if verb not in GRAMMAR:
        raise MeasureError(f"unknown aggregate verb '{verb}'")
    kinds, restricted, build = GRAMMAR[verb]
    args: list = []
    for mark, kind in zip("(" + "," * (len(kinds) - 1), kinds or [None]):
        _expect(tokens, mark)
        if kind:
            args.append(_call(tokens, True) if kind == "aggregate" else _expect(tokens, kind))
    _expect(tokens, ")")
    given = tokens[:1] == ["where"]
    if inside and given:
        raise MeasureError("an inner aggregate may not carry a 'where'")
    if restricted and not given:
        raise MeasureError(f"{verb}(...) requires a 'where' restriction")
    where = None
    if given and restricted is not False:
        tokens.pop(0)
        channel, _, literal = (_expect(tokens, k) for k in ("dimension", "=", "literal"))
        where = Where(channel, literal[1:-1])
    return build(args, where)


def parse(text: str) -> Expr:
    tokens = _LEXEME.findall(text or "")
    out = _call(tokens)
    if tokens:
        raise MeasureError(f"unexpected trailing token '{tokens[0]}'")
    return out


def inner_of(e: Expr) -> Agg:
    return e if isinstance(e, Agg) else e.inner


def dimensions(e: Expr) -> list[str]:
    """The dict channels an expression reads."""
    own = [e.dimension] if isinstance(e, ArgExtreme) else []
    return own + [w.channel for w in (getattr(e, "where", None), inner_of(e).where if e is not inner_of(e) else None) if w]


# --- partials ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Partial:
    """An additive piece of an aggregate, stored as f32 (counts as int) per cell."""

    kind: str  # sum, cnt, swp, min, max
    channel: str | None = None
    weight: str | None = None

    @property
    def name(self) -> str:
        return "__".join(x for x in (self.kind, self.channel, self.weight) if x)

    def from_facts(self) -> Column:
        value = F.col(self.channel).cast("double") if self.channel else None
        if self.kind == "cnt":
            return F.count(F.lit(1)).cast("int").alias(self.name)
        if self.kind == "swp":
            return F.coalesce(F.sum(value * F.col(self.weight).cast("double")), F.lit(0.0)).cast("float").alias(self.name)
        if self.kind == "sum":
            return F.coalesce(F.sum(value), F.lit(0.0)).cast("float").alias(self.name)
        return (F.min(value) if self.kind == "min" else F.max(value)).cast("float").alias(self.name)

    def merged(self) -> Column:
        """The same partial over a union of cells, for cube maintenance."""
        c = F.col(self.name)
        if self.kind == "cnt":
            return F.sum(c).cast("int").alias(self.name)
        return {"min": F.min, "max": F.max}.get(self.kind, lambda x: F.sum(x.cast("double")))(c).cast("float").alias(self.name)


_NEEDS = {
    "sum": lambda a: [Partial("sum", a.channel)],
    "count": lambda a: [Partial("cnt")],
    "avg": lambda a: [Partial("sum", a.channel), Partial("cnt")],
    "wavg": lambda a: [Partial("swp", a.channel, a.weight), Partial("sum", a.weight)],
    "min": lambda a: [Partial("min", a.channel)],
    "max": lambda a: [Partial("max", a.channel)],
}


def partials(exprs) -> list[Partial]:
    """Each partial once, in order of first use."""
    return list(dict.fromkeys(p for e in exprs for p in _NEEDS[inner_of(e).verb](inner_of(e))))


# --- finals -----------------------------------------------------------------------------------------------------


def over_partials(a: Agg, where: Column | None = None) -> Column:
    """An aggregate from cells' partials, f64."""

    def total(p: Partial) -> Column:
        c = F.col(p.name).cast("double")
        c = c if where is None else F.when(where, c)
        return {"min": F.min, "max": F.max}.get(p.kind, F.sum)(c)

    first, *rest = [total(p) for p in _NEEDS[a.verb](a)]
    if rest:
        return first / F.nullif(rest[0], F.lit(0.0))
    return F.coalesce(first, F.lit(0.0)) if a.verb in ("sum", "count") else first


def over_facts(a: Agg, where: Column | None = None) -> Column:
    """The same aggregate straight from facts, with the fold's null rules."""
    keep = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    value = keep(F.col(a.channel).cast("double")) if a.channel else None
    if a.verb == "count":
        return F.count(keep(F.lit(1))).cast("double")
    if a.verb == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if a.verb == "avg":
        return F.coalesce(F.sum(value), F.lit(0.0)) / F.nullif(F.count(keep(F.lit(1))).cast("double"), F.lit(0.0))
    if a.verb == "wavg":
        w = F.col(a.weight).cast("double")
        return F.sum(value * w) / F.nullif(F.sum(keep(w)), F.lit(0.0))
    return F.min(value) if a.verb == "min" else F.max(value)


def flat(e: Agg | Share, source=over_partials, inside: Column | None = None) -> Column:
    """A measure that one grouping by mark can compute, over the rows inside a context."""

    def kept(w: Where | None) -> Column | None:
        own = None if w is None else F.col(w.channel) == w.value
        return own if inside is None else inside if own is None else inside & own

    if isinstance(e, Share):
        return F.coalesce(source(e.inner, kept(e.where)), F.lit(0.0)) / F.nullif(source(e.inner, kept(None)), F.lit(0.0))
    return source(e, kept(e.where))


def extreme(value: Column, by: Column, largest: bool = True) -> Column:
    """The value with the extremal `by`, the lowest on ties; no domain is needed, order of text is order of codes."""
    return F.min_by(value, F.struct(-by if largest else by, value))
