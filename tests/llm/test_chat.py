"""Chat formatting: exact round trips and layouts."""

import json
import random

import pytest
from backmatch.llm import chat
from pyspark.sql import functions as F

PARTS = ["<|end|>", "<|text|>", "<|turn|>", "<\\|end|>", "<\\\\|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "[\\INST]", "\\", "<", "|", "a", "\n", "é😀", "$1", " "]


def rows(spark, turns):
    return spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")


def test_round_trip(spark):
    rng = random.Random(7)
    turns = [(c, t, rng.choice(("user", "assistant", "system", "<|end|>", None)), None if rng.random() < 0.05 else "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 12)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    turns += [(0, 0, "user", "again"), (0, 0, "user", "again"), (None, 0, "user", "lost")]
    got = chat.format_turns(chat.turn_rows(rows(spark, turns)))
    out = got.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("m")).collect()
    expected = {}
    for c, t, r, x in turns:
        expected.setdefault(c, []).append((t, r or "", x or ""))
    assert len(out) == len(expected)
    for r in out:
        want = sorted(expected[r["conv_id"]])
        assert [(x["role"], x["text"]) for x in r["t"]] == [(a, b) for _, a, b in want]
        assert r["m"] == [b for _, a, b in want if a == "assistant"]


def test_escapes_hide_control_strings(spark):
    texts = ["".join(random.Random(i).choice(PARTS) for _ in range(10)) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not any(x in r["e"] for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_layouts_of_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "completion": "yo"},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"instruction": "hi", "output": "yo"},
        {"question": "hi", "answer": "yo"},
    ]
    records += [r | {"id": i, "source": {"of": [{"role": "x"}]}} for i, r in enumerate(records)]  # further fields change nothing
    texts = [*map(json.dumps, records), '{"other": 1}', '{"other": {"prompt": "a", "completion": "b"}}', '{"messages": []}', '{"messages": "x"}', "[1]", "no json", "", None]
    got = chat.record_turns(spark.createDataFrame(list(enumerate(texts)), "i int, record string")).orderBy("i").collect()
    for r in got[: len(records)]:
        assert [(x["role"], x["text"]) for x in r["turns"]] == [("user", "hi"), ("assistant", "yo")]
    assert all(r["turns"] is None for r in got[len(records) :])
    assert len({r["layout"] for r in got[: len(records)]}) == len(records) // 2
    assert [r["layout"] for r in got[: len(records) // 2]] == [r["layout"] for r in got[len(records) // 2 : len(records)]]


def test_the_fingerprint_is_a_hash_of_the_paths(spark):
    """The same in Spark and on the driver, for a table and for records; an unknown table is refused."""
    m = chat.MAPPINGS[0]
    assert chat.fingerprint(list(m.paths)) == spark.sql("select xxhash64('messages[].content,messages[].role')").first()[0]
    nested = spark.createDataFrame([], "id int, messages array<struct<role:string,content:string,score:double>>")
    assert chat.table_fingerprint(nested, chat.MAPPINGS) == chat.fingerprint(list(m.paths))
    other = spark.createDataFrame([(1, 0, "user", "x", 3)], "conversation_id int, message_index int, role string, content string, score int")
    assert chat.turn_rows(other).columns == ["conv_id", "turn", "role", "text"]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turn_rows(other.drop("role"))


def test_clashing_columns_and_long_records(spark):
    long = "x" * 500_000
    df = spark.createDataFrame([(json.dumps({"prompt": long, "completion": "<|end|>"}), 1, 2)], "record string, layout int, Turns int")
    got = chat.record_turns(df)
    assert got.columns == ["record", "layout", "turns"] and got.first()["turns"][0]["text"] == long
    out = chat.format_turns(chat.turns_to_rows(got.withColumn("conv_id", F.lit(5)))).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [x["text"] for x in out] == [long, "<|end|>"]


def test_empty_and_extra_columns(spark):
    assert chat.format_turns(chat.turn_rows(rows(spark, []))).count() == 0
    df = rows(spark, [(1, 0, "user", "x")]).withColumn("formatted", F.lit("clash")).withColumn("at", F.lit(3))
    assert chat.format_turns(chat.turn_rows(df)).first()["formatted"] == "<|turn|>user<|text|>x<|end|>"
