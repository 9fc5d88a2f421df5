"""Chat records of any layout as canonical turns, chosen by schema fingerprint, and a reversible chat template.

A record is JSON text. Its fingerprint is the hash of its nested field paths (names and nesting, not types or order
of rows); fingerprints select declarative mappings, which say where role and text of each turn lie. Formatting marks
turns with control strings and escapes control strings inside texts; the loss mask holds, for each turn, the span of
its text in code points and whether it is trained on. All in DataFrame functions.

Cases: null texts and roles count as empty; a record whose fingerprint no mapping knows gets null turns (and is
reported, not dropped); turns are ordered by (turn, role, text), so repeated rows stay and ties are settled; a null
conversation id is one conversation. A conversation is one string by nature and must fit a task.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spare

TURN, TURNS = "struct<role:string,text:string>", "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """Either a list of messages with a role and a text field, or single fields with fixed roles, in order.

    optional: paths that a record may lack; roles: names to rename.
    """

    name: str
    messages: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ("conv_id", "id")
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))

    def shapes(self) -> list[str]:
        """Canonical path texts of all records this mapping reads."""
        own = [f"{self.messages}[]", f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"] if self.messages else [f for f, _ in self.fields if f not in self.optional]
        out = [own]
        for x in (*self.optional, *self.extra):
            out += [[*o, x] for o in out]
        return sorted({",".join(sorted(o)) for o in out})


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("turns", "turns", "role", "text"),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("prompt-completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("prompt-response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("question-answer", fields=(("context", "system"), ("question", "user"), ("answer", "assistant")), optional=("context",)),
)


def paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON record: two levels, lists marked []. Null for anything but an object."""
    top = F.json_object_keys(record)

    def below(key: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))
        listed = F.from_json(value, "array<string>")
        inner = lambda k: F.concat(key, F.lit("[]."), k)
        keys = F.array_distinct(F.flatten(F.transform(F.filter(listed, lambda x: F.json_object_keys(x).isNotNull()), lambda x: F.json_object_keys(x))))
        return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.concat(F.array(F.concat(key, F.lit("[]"))), F.transform(keys, inner))).when(
            F.startswith(F.ltrim(value), F.lit("{")), F.transform(F.json_object_keys(value), lambda k: F.concat(key, F.lit("."), k))
        ).otherwise(F.array(key))

    return F.array_sort(F.flatten(F.transform(top, below)))


def fingerprint(record: Column) -> Column:
    return F.xxhash64(F.array_join(paths(record), ","))


def _turns(m: Mapping, record: Column) -> Column:
    field = lambda x, name: F.coalesce(F.get_json_object(x, f"$['{name}']"), F.lit(""))
    if m.messages:
        said = F.transform(F.from_json(F.get_json_object(record, f"$['{m.messages}']"), "array<string>"), lambda x: F.struct(field(x, m.role).alias("role"), field(x, m.text).alias("text")))
        names = F.create_map(*[F.lit(x) for pair in m.roles for x in pair])
        return F.transform(said, lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))
    each = F.array(*[F.when(F.get_json_object(record, f"$['{f}']").isNotNull(), F.struct(F.lit(r).alias("role"), F.get_json_object(record, f"$['{f}']").alias("text"))) for f, r in m.fields])
    return F.filter(each, lambda t: t.isNotNull())


def mapping_of(shape: Column, mappings=MAPPINGS) -> Column:
    """Name of the mapping whose layouts have this fingerprint; null where none has. The list is fixed and small."""
    known = F.create_map(*[x for m in mappings for s in m.shapes() for x in (F.xxhash64(F.lit(s)), F.lit(m.name))])
    return F.try_element_at(known, shape)


def turns_of(record: Column, mapping: Column, mappings=MAPPINGS) -> Column:
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(mapping == m.name, _turns(m, record).cast(TURNS)).otherwise(turns)
    return turns


def canonical(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """records with fingerprint, mapping (null: unknown) and turns; columns of records with such names stay, and the new
    ones then end in an underscore."""
    shape, name, turns = spare(records, "fingerprint", "mapping", "turns")
    out = records.withColumn(shape, fingerprint(F.col(record)))
    out = out.withColumn(name, mapping_of(F.col(shape), mappings))
    return out.withColumn(turns, turns_of(F.col(record), F.col(name), mappings))


def escaped(text: Column) -> Column:
    """Backslashes double; one goes between the first character of a control string and the rest."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?=[|/sI<])", "$1"), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    """A role in one line: a line break becomes backslash, n, which doubling leaves free."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    """Backslash, n is a line break only after an even number of backslashes."""
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted(turns: Column, trained=("assistant",)) -> Column:
    """struct(text, mask): the formatted string and (start, end, loss) per turn, in one pass over the turns."""
    each = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*trained).alias("loss")))

    def joined(p: Column) -> Column:
        step = lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long").alias("at"),
            F.concat(a["mask"], F.array(F.struct((a["at"] + F.length(x["head"])).cast("long").alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).cast("long").alias("end"), x["loss"].alias("loss")))).alias("mask"),
        )
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,loss:boolean>>").alias("mask"))
        return F.struct(F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("text"), F.aggregate(p, zero, step)["mask"].alias("mask"))

    return let(each, joined)


def read_back(text: Column) -> Column:
    """Turns of a formatted string, unescaped."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.locate("\n", p) + 1)
    role = lambda p: F.substr(p, F.lit(len(START) + 1), F.locate("\n", p) - len(START) - 1)
    return F.transform(parts, lambda p: F.struct(_unrole(role(p)).alias("role"), unescaped(body(p)).alias("text")))


def conversations(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation from rows by turn: conv_id, record."""
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("s"))
    return grouped.select("conv_id", F.to_json(F.struct(F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))).alias("record"))


def format_records(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """records with fingerprint, mapping, turns, formatted and mask, named as `canonical` says."""
    turns, both, text, mask = spare(records, "turns", "both", "formatted", "mask")
    out = canonical(records, record, mappings).withColumn(both, formatted(F.col(turns)))
    return out.select("*", F.col(both)["text"].alias(text), F.col(both)["mask"].alias(mask)).drop(both)


def loss_text(formatted_: Column, mask: Column) -> Column:
    """What lies under the loss mask of a formatted string, unescaped, joined."""
    cut_ = lambda m: unescaped(F.substr(formatted_, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    return F.array_join(F.transform(F.filter(mask, lambda m: m["loss"]), cut_), "")


def report(rows: DataFrame) -> DataFrame:
    """The contract's digests, all taken from the formatted strings and their masks."""
    check = F.lit("</s>[INST] ok [/INST]")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), check.alias("text"))
    out = format_records(conversations(rows.unionByName(own))).select("conv_id", "mapping", "formatted", "mask")
    out = out.withColumn("t", read_back(F.col("formatted")))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("mask"))
    return out.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "mapping",
    )
