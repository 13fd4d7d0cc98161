"""Operator 4, chat formatting by schema fingerprints, in SQL functions only.

The fingerprint of a layout is a hash of those of its nested field paths that
some mapping knows, so further fields (ids, sources, scores) don't hide it.
It selects a declarative mapping to canonical turns (role, text): for a typed
table the paths are those of its schema, hashed once; for JSON records those
of each record, so one table may hold many layouts.  Canonical turns are
written with one template:

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings in roles and texts are escaped by one backslash after their
first character, which is reversible, as any backslashes already there move
along.  The loss mask holds the ranges of the assistant's escaped texts.

Defined results: null text or role is empty; rows with the same conversation
and turn are ordered by role, then text, and repeated rows are turns of their
own; a null conv_id is a conversation; very long texts are written whole; a
record whose layout is unknown or that isn't JSON gets a null array of turns;
a table of unknown layout is an error; an empty table gives an empty result;
extra columns are ignored, and one named like a result (layout, turns) is
replaced by it.  A conversation is one row of the output, so its turns meet
in one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: A control string is an opening character and one of these; that covers the template's own and other common ones.
_TAIL = r"\||/?s>|/?INST\]|/?SYS>"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAIL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAIL})", "$1$2$3")


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, in order; ``[]`` marks an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(known: list[str]) -> int:
    """The hash of paths that a mapping knows, in order; Spark's ``xxhash64`` of their text gives the same."""
    h = xxhash.xxh64_intdigest(",".join(sorted(known)), 42)
    return h - (h >> 63 << 64)


def record_paths(record: Column, known: list[str]) -> Column:
    """Which of the ``known`` paths (``a`` or ``a[].b``) a JSON record has, in order; null if it is no JSON object."""
    top = F.json_object_keys(record)
    outer = sorted({p.partition("[].")[0] for p in known if "[]." in p})
    lists = F.from_json(record, ", ".join(f"`{o}` array<string>" for o in outer)) if outer else None

    def has(path: str) -> Column:
        name, _, field = path.partition("[].")
        got = F.array_contains(top, name)
        if field:
            got &= F.exists(lists[name], lambda x: F.array_contains(F.json_object_keys(x), field))
        return F.when(got, path)

    return F.when(top.isNotNull(), F.array_compact(F.array(*map(has, sorted(known)))))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _each(record: Column, field: str, role: str, text: str) -> Column:
    got = F.from_json(record, f"`{field}` array<struct<`{role}`:string,`{text}`:string>>")[field]
    return F.transform(got, lambda t: _turn(t[role], t[text]))


def _pair(record: Column, asks: tuple[str, ...], answer: str) -> Column:
    got = F.from_json(record, ", ".join(f"`{x}` string" for x in (*asks, answer)))
    ask = F.array_join(F.filter(F.array(*(got[a] for a in asks)), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return F.array(_turn(F.lit("user"), ask), _turn(F.lit("assistant"), got[answer]))


@dataclass(frozen=True)
class Mapping:
    """A layout, given by its field paths, and how it becomes turns: for records a function of the
    JSON, for tables with a row for each turn the columns conversation, order, role, text."""

    name: str
    paths: tuple[str, ...]
    turns: object


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _usual_roles(turns: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    return F.transform(turns, lambda t: _turn(F.coalesce(F.try_element_at(names, t["role"]), t["role"]), t["text"]))


MAPPINGS = [
    Mapping("messages", ("messages[].role", "messages[].content"), lambda r: _each(r, "messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), lambda r: _each(r, "turns", "role", "text")),
    Mapping("shared", ("conversations[].from", "conversations[].value"), lambda r: _usual_roles(_each(r, "conversations", "from", "value"))),
    Mapping("prompt-completion", ("prompt", "completion"), lambda r: _pair(r, ("prompt",), "completion")),
    Mapping("prompt-response", ("prompt", "response"), lambda r: _pair(r, ("prompt",), "response")),
    Mapping("instruction", ("instruction", "output"), lambda r: _pair(r, ("instruction",), "output")),
    Mapping("instruction-input", ("instruction", "input", "output"), lambda r: _pair(r, ("instruction", "input"), "output")),
    Mapping("question", ("question", "answer"), lambda r: _pair(r, ("question",), "answer")),
]
ROW_MAPPINGS = [
    Mapping("turn-rows", ("conv_id", "turn", "role", "text"), ("conv_id", "turn", "role", "text")),
    Mapping("message-rows", ("conversation_id", "message_index", "role", "content"), ("conversation_id", "message_index", "role", "content")),
]


def record_turns(records: DataFrame, record: str = "record", mappings: list[Mapping] | None = None) -> DataFrame:
    """``records`` with layout (fingerprint) and turns, the mapping chosen for each row by its fingerprint."""
    mappings = MAPPINGS if mappings is None else mappings
    known = sorted({p for m in mappings for p in m.paths})
    (at,) = unused(records, "layout")
    got = records.withColumn(at, F.xxhash64(F.array_join(record_paths(F.col(record), known), ",")))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col(at) == fingerprint(list(m.paths)), m.turns(F.col(record)).cast(TURNS)).otherwise(turns)
    kept = [c for c in records.columns if c.lower() not in ("layout", "turns")]
    return got.select(*kept, F.col(at).alias("layout"), turns.alias("turns"))


def table_fingerprint(rows: DataFrame, mappings: list[Mapping] | None = None) -> int:
    """The fingerprint of a typed table's field paths."""
    known = {p for m in mappings or ROW_MAPPINGS for p in m.paths}
    return fingerprint([p for p in paths(rows.schema) if p in known])


def turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with a row for each turn, by the mapping that its fingerprint selects."""
    chosen = {fingerprint(list(m.paths)): m for m in ROW_MAPPINGS}.get(table_fingerprint(rows))
    if chosen is None:
        raise ValueError(f"no mapping for the field paths {paths(rows.schema)}")
    conv, turn, role, text = chosen.turns
    return rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def turns_to_rows(records: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of what ``record_turns`` gives; records without turns are left out."""
    return records.select(F.col(conv_id).cast("long").alias("conv_id"), F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of start, end in code points) of canonical turn rows.

    One shuffle by conversation serves the running offsets and the grouping.
    """
    t = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")))
    start = F.col("at") + F.length("head")
    mask = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    got = t.select("conv_id", F.struct("at", "piece").alias("p"), mask.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("m")).alias("mask"))
    return got.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "mask")


def read_turns(formatted: Column) -> Column:
    """The canonical turns of a formatted conversation."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    halves = F.transform(pieces, lambda p: F.split(p, r"<\|text\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(h[1]).alias("text")))


def read_masked(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return F.transform(mask, lambda m: unescape(formatted.substr((m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` through the fingerprint of its schema, and conversation -7 as a JSON record
    through that of the record; layout is the smallest fingerprint of a conversation's rows."""
    told = table(spark, sf_dir, "conversations")
    rows = turn_rows(told)
    tricky = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": tricky}, {"role": "assistant", "content": tricky}], "id": "planted"})
    planted = turns_to_rows(record_turns(spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(record).alias("record"))))
    got = format_turns(rows.unionByName(planted))
    got = got.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_masked(F.col("formatted"), F.col("mask")), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    layout = F.when(F.col("conv_id") == -7, fingerprint(list(MAPPINGS[0].paths))).otherwise(table_fingerprint(told))
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), layout.alias("layout"))
