"""Personal data: base detection plus information-theoretic sanitisation of secrets and of disclosing context terms.

Protected entities are the distinct values found by the base rules and what they share with others: domain and local
part of an e-mail, networks of an ip, issuer prefix of a card, prefixes of a phone. So a value seen in one text is
estimated by its levels. A run of SECRET_CHARS letters and digits or more, both among them, whose own information (its
length times the entropy of its characters) reaches SECRET_BITS names somebody or something whatever it is: it is a
secret, a protected entity of its own, and always a span.

Every term of a document is paired with every entity of it. Over the whole corpus, with N documents, n(e) documents of
an entity, n(t) of a term and n(e,t) of both,

    IC(e) = log2(N / n(e))        PMI(e, t) = log2(n(e,t) * N / (n(e) * n(t)))

A term that two or more different texts hold with e and whose PMI reaches IC(e) / alpha tells at least 1/alpha of what
the entity's name itself tells: all its occurrences in documents of e are generalised, and removed where PMI comes within
one bit of IC(e). PMI is at most log2(N / n(t)), so a term with n(t) > N (n(e) / N)^(1/alpha) cannot disclose e; pairs
whose term is known to be that frequent are never made. The terms told to the tasks for this are the most frequent ones:
those in at least 1 / FREQUENT of all (document, term) incidences, so there are at most FREQUENT of them at any size.

Counts are Spark aggregations; a task holds one batch of texts and a bounded dictionary. Texts without an entity shared
by two different texts leave before terms are paired.

Cases: null text counts as empty; null ids are kept; equal rows get equal results; empty tables give empty results.
Copies count as documents but not as further evidence (two *different* texts are needed). Spans are code points.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, cut, limit_batches, spare, spread

KINDS = ("email", "ip", "card", "phone", "term", "secret")
ALPHA, FLUSH, FREQUENT, SECRET_CHARS, SECRET_BITS = 1.5, 200_000, 100_000, 16, 45.0
STRIP = b".,;:!?\"'()[]{}<>|*#$%&=+-_/\\"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(rf"[A-Za-z0-9]{{{SECRET_CHARS},}}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Linear form of the leftmost rule: an '@' is in neither class, so every match surrounds exactly one."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered. Failing matches are dropped, never retried."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def information(value: str) -> float:
    """Bits of a string under the frequencies of its own characters."""
    return sum(n * log2(len(value) / n) for n in Counter(value).values())


def secrets(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs that carry enough information by themselves and lie outside the given spans."""
    out, at, upto = [], 0, 0
    for m in _RUN.finditer(text):
        run = m[0]
        while at < len(spans) and spans[at][0] < m.end():
            upto = max(upto, spans[at][2])
            at += 1
        if m.start() >= upto and not run.isdigit() and not run.isalpha() and information(run) >= SECRET_BITS:
            out.append((m.start(), 5, m.end()))
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with secrets, ordered."""
    base = base_spans(text)
    return base, sorted(base + secrets(text, base))


def _trimmed(word: str) -> tuple[str, int]:
    """A word as a term, lower case without edge punctuation, and how much was cut on the left."""
    raw = word.encode()
    left = raw.lstrip(STRIP)
    return left.rstrip(STRIP).decode(), len(raw) - len(left)


def entities(kind: int, raw: str) -> list[int]:
    """The value of a mention and its levels, as hashes."""
    value = re.sub(r"[ ().-]", "", raw) if 1 < kind < 4 else raw.lower()
    if kind == 5:
        levels = []
    elif kind == 0:
        local, _, domain = value.rpartition("@")
        levels = [f"local:{local}", f"domain:{domain}"]
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        levels = [f"net:{'.'.join(parts[:n])}" for n in (2, 3)]
    elif kind == 2:
        levels = [f"issuer:{value[:6]}"]
    else:
        levels = [f"prefix:{value[:n]}" for n in (-7, -4) if len(value) + n > 1]
    return [_signed(f"{kind}:{x}".encode()) for x in (value, *levels)]


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    return sorted({x for s, kind, e in spans for x in entities(kind, text[s:e])})


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(term, start, end) of every word of the text outside the spans."""
    out, at, upto = [], 0, 0
    for m in _WORD.finditer(text):
        term, left = _trimmed(m[0])
        a = m.start() + left
        b = a + len(term)
        while at < len(spans) and spans[at][0] < b:
            upto = max(upto, spans[at][2])
            at += 1
        if len(term) > 1 and a >= upto:
            out.append((_signed(term.lower().encode()), a, b))
    return out


def context_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, end): every entity of the document with every term of it."""
    return sorted({(e, *t) for e in entities_of(text, spans) for t in terms_of(text, spans)}) if spans else []


def _signed(raw: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_TERM = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]))
_FOUND = "uid long, doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:int,kind:int,end:int>>, ents array<long>, text string"
TERMS = "array<struct<start:int,kind:int,end:int,remove:boolean>>"


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _find(batches):
    """Spans and entities of each text; the text itself goes on only where it holds an entity."""
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 33
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            base, spans = all_spans(text)
            n = Counter(k for _, k, _ in base)
            ents = entities_of(text, spans) if spans else []
            rows.append((uid, n[0], n[1], n[2], n[3], hashlib.sha256(_joined(base).encode()).hexdigest(), [dict(zip(("start", "kind", "end"), x)) for x in spans], ents, text if ents else None))
            uid += 1
        cols = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64()] * 5 + [pa.string(), _SPAN, pa.list_(pa.int64()), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([arrays[0], b.column("doc_id"), b.column("th"), *arrays[1:]], names=["uid", "doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "ents", "text"])


def _term_counts(batches):
    """Documents per term, summed per partition in a dictionary of at most about FLUSH entries."""
    counts: Counter = Counter()

    def flush():
        merged: Counter = Counter()
        for raw, n in counts.items():
            merged[_signed(raw)] += n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int64()), pa.array(list(merged.values()), pa.int64())], names=["t", "n_t"])

    for b in batches:
        for text in b.column("text").to_pylist():
            if text:
                counts.update({w.strip(STRIP) for w in set(text.lower().encode().split())})
                if len(counts) > FLUSH:
                    yield flush()
    yield flush()


def _spans_of(row) -> list[tuple[int, int, int]]:
    return [(x["start"], x["kind"], x["end"]) for x in row]


def _paired(frequent: dict[int, int], n: float, alpha: float):
    """(uid, th, e, n_e, t): entities of a text with its terms, but for terms too frequent to disclose the entity."""

    def apply(batches):
        keys = np.array(sorted(frequent), np.int64)
        known = np.array([frequent[k] for k in keys.tolist()], np.float64)
        for b in batches:
            for uid, th, text, spans, ents in zip(*(b.column(c).to_pylist() for c in ("uid", "th", "text", "spans", "known"))):
                t = np.unique(np.array([x[0] for x in terms_of(text, _spans_of(spans))], np.int64))
                at = np.minimum(np.searchsorted(keys, t), max(0, len(keys) - 1))
                n_t = np.where(keys[at] == t, known[at], 0.0) if len(keys) else np.zeros(len(t))
                out = []
                for x in ents:
                    limit = n * (x["n_e"] / n) ** (1 / alpha) * (1 + 1e-9)
                    out.append((x["e"], x["n_e"], t[n_t <= limit]))
                sizes = [len(o[2]) for o in out]
                m = sum(sizes)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, uid)), pa.array(np.full(m, th)), pa.array(np.repeat([o[0] for o in out], sizes)), pa.array(np.repeat([o[1] for o in out], sizes)), pa.array(np.concatenate([o[2] for o in out]))], names=["uid", "th", "e", "n_e", "t"])

    return apply


def _placed(batches):
    """(uid, terms): where a text holds its disclosing terms."""
    for b in batches:
        out = []
        for text, spans, told in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "told"))):
            remove = {x["t"]: x["remove"] for x in told}
            out.append([{"start": s, "kind": 4, "end": e, "remove": remove[t]} for t, s, e in terms_of(text, _spans_of(spans)) if t in remove])
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out, _TERM)], names=["uid", "terms"])


def disclosing(found: DataFrame, docs: DataFrame, stash: Stash, alpha: float) -> DataFrame:
    """(uid, terms): spans of the terms that disclose an entity of their document beyond the threshold."""
    n = float(found.count())
    held = found.where("text IS NOT NULL")
    ents = held.select("uid", "th", F.explode("ents").alias("e"))
    known = ents.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").where(F.col("n") < n).select("e", "n", F.col("n").alias("n_e"))
    carried = spread(ents.select("uid", "e"), known, ["e"], ents.count(), F.col("uid")).groupBy("uid").agg(F.collect_list(F.struct("e", "n_e")).alias("known"))
    counts = stash.put(docs.select("text").mapInArrow(_term_counts, "t long, n_t long").groupBy("t").agg(F.sum("n_t").alias("n_t")).where("n_t > 1"))
    incidences = counts.agg(F.sum("n_t")).first()[0] or 0
    frequent = {r.t: r.n_t for r in counts.where(F.col("n_t") >= max(2, incidences / FREQUENT)).collect()}
    pairs = stash.put(held.join(carried, "uid").select("uid", "th", "text", "spans", "known").mapInArrow(_paired(frequent, n, alpha), "uid long, th long, e long, n_e long, t long"))
    both = pairs.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("a"), F.max("th").alias("b"), F.first("n_e").alias("n_e")).where("a <> b")
    ic, pmi = F.log2(n / F.col("n_e")), F.log2(F.col("n") * n / (F.col("n_e") * F.col("n_t")))
    told = both.join(counts, "t").where(pmi >= ic / alpha - 1e-12).select("e", "t", "n", (pmi >= ic - 1).alias("remove"))
    hits = spread(pairs.select("uid", "e", "t"), stash.put(told), ["e", "t"], pairs.count(), F.col("uid"))
    hits = hits.groupBy("uid", "t").agg(F.max("remove").alias("remove")).groupBy("uid").agg(F.collect_list(F.struct("t", "remove")).alias("told"))
    return held.join(hits, "uid").select("uid", "text", "spans", "told").mapInArrow(_placed, f"uid long, terms {TERMS}")


def find(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, th (hash of the text), base counts and digest, spans (base and secrets) and the term spans, a row per row.

    docs: doc_id, text. Extra columns are ignored.
    """
    limit_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with Stash(docs.sparkSession) as stash:
        found = stash.put(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_find, _FOUND))
        terms = disclosing(found, docs, stash, alpha)
        return cut(found.drop("ents", "text").join(terms, "uid", "left").drop("uid"))


def report(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The contract's row for each document, with the number of secrets and disclosing terms."""
    term = F.transform(F.coalesce("terms", F.array().cast(TERMS)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    kind = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(F.array_sort(F.concat("spans", term)), lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"], x["end"])), ",")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return find(docs, alpha).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), n(F.filter("spans", lambda x: x["kind"] == 5)).alias("n_secrets"), n("terms").alias("n_terms"))


def redact(text: str, terms) -> str:
    """Base spans and secrets become their kind; terms a coarse class, or nothing where removed. Overlaps merge to one mark."""
    spans = [(s, f"[{KINDS[k].upper()}]", e) for s, k, e in all_spans(text)[1]]
    for x in terms or ():
        word = text[x["start"] : x["end"]]
        spans.append((x["start"], "" if x["remove"] else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]", x["end"]))
    out, at = [], 0
    for s, mark, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs with their text sanitised; all columns and rows stay, whatever their names. Null texts stay null.

    Rows are matched to their terms by (doc_id, hash of the text); equal rows share them.
    """
    key, found, ids, hashed = spare(docs, "key", "terms", "id", "th")
    terms = find(docs, alpha).where("terms is not null").groupBy("doc_id", "th").agg(F.first("terms").alias(found)).withColumnsRenamed({"doc_id": ids, "th": hashed})
    joined = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(terms, F.col("doc_id").cast("long").eqNullSafe(F.col(ids)) & (F.col(key) == F.col(hashed)), "left")
    schema = docs.schema

    def apply(batches):
        for b in batches:
            new = [None if t is None else redact(t, x) for t, x in zip(b.column("text").to_pylist(), b.column(found).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if f == "text" else b.column(f) for f in schema.names], names=schema.names)

    return joined.select(*schema.names, found).mapInArrow(apply, schema)
