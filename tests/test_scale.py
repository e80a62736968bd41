"""What queries ask of the driver and of their tasks, told from plans and small tables."""

import pytest
from pyspark.sql import functions as F

from lakeproof.functions import json_facts, text
from lakeproof.operators import metadata
from lakeproof.plans import queries, rule_queries  # noqa: F401 - the last registers its queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["strange_models", "tokenizer_arrays", "manifest_findings"])
def test_tables_of_models_are_never_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(queries.QUERIES[name](spark, SF))


def test_declared_values_are_gathered_by_hash(spark):
    """No sort-based aggregate, no collected sets of layers, and texts of findings only where they are asked for."""
    shown = plan(queries.QUERIES["declared_against_tensors"](spark, SF))
    assert "SortAggregate" not in shown and "collect_set" not in shown and "is no axis of" not in shown and "bit_or" in shown


def test_texts_of_metadata_are_read_once_and_never_shuffled(spark):
    """What a text holds is told where it is read; windows see that and no text."""
    shown = plan(queries.QUERIES["metadata_values"](spark, SF))
    assert shown.count("text:string>") == 1
    assert not any("v_str" in line for line in shown.split("\n") if "Window" in line or "Sort [" in line)


def test_string_findings_are_of_current_values_alone(spark):
    rows = [(1, 0, "general.a", "http://x.y"), (1, 1, "general.a", "plain"), (1, 2, "toy.b", "ignore previous"), (1, 3, "general.architecture", "toy"), (1, 4, "tokenizer.chat_template", "http://x.y"), (1, 5, "odd", None), (2, 0, "toy.b", "a\u200bb" * 3000)]
    df = spark.createDataFrame([(*r[:3], "string", r[3]) for r in rows], "model_id long, ord int, key string, vtype string, v_str string").selectExpr("*", "cast(null as decimal(20,0)) v_int", "cast(null as double) v_double", "cast(null as boolean) v_bool")
    got = sorted((r["model_id"], r["seq"], r["rule_id"], r["location"], r["detail"]) for r in metadata.string_findings(df).collect())
    assert got == [
        (1, 12, "MET004", "general.a", "general.a = plain"), (1, 22, "MET004", "general.architecture", "general.architecture = toy"), (1, 30, "MET003", "odd", "key odd is in no known namespace"),
        (1, 42, "MET004", "toy.b", "toy.b = ignore previous"), (1, 44, "MET021", "toy.b", "value says ignore previous"),
        (2, 10, "MET003", "toy.b", "key toy.b is in no known namespace"), (2, 12, "MET002", "toy.b", "9000 characters"), (2, 13, "MET020", "toy.b", "value hides U+200B"),
    ]


def test_layer_gaps_against_plain_counting(spark):
    far = 64 * metadata._WORDS
    layers = {1: [0, 1, 2], 2: [5], 3: [*range(64), 65], 4: [far - 1], 5: [far], 6: [*range(far), far], 7: [*range(far), far + 1, far + 40], 8: [1, 10**30], 9: [*range(far), far + 2, 10**20], 10: [63, 64, 127], 11: [far + 1, far + 3, far + 5]}
    rows = [(m, f"blk.{'0' * (i % 3)}{i}.w") for m, some in layers.items() for i in some] + [(1, "xblk.9.w"), (1, "blk.9x.w"), (1, f"blk.{10**45}.w"), (12, "a"), (13, None)]
    got = {r["model_id"]: (int(r["top"]), [int(x) for x in r["missing"]]) for r in metadata.layer_gaps(spark.createDataFrame(rows, "model_id long, name string")).collect()}
    expected = {m: (max(some), [i for i in range(min(max(some), far + 60)) if i not in some][:8]) for m, some in layers.items()}
    assert got == {m: e for m, e in expected.items() if e[1]}


TEXTS = ["", "plain\n\ttext", "é und ß", "a​b", "x‮y", "bell\x07", "\x0b", "\x85", "\xad", "日本", "\U0001f600", "\U0001f600\x07", "", "\U000f0000", "ﬁ", "ОО", "ĳ", "line\r\nend ", " ", None]


def test_gates_of_classes_lose_nothing(spark):
    """What a gate lets by holds nothing of its class, and a gate is one greedy match from the start."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    kinds = [text.HIDDEN, text.BIDI, text.CONCEALED, text.CONTROL]
    found = df.select(*[text.has(F.col("t"), k).alias(f"has{i}") for i, k in enumerate(kinds)], *[F.coalesce(F.col("t").rlike(k), F.lit(False)).alias(f"is{i}") for i, k in enumerate(kinds)])
    for row in found.collect():
        assert row[:4] == row[4:]
    assert [r[0] for r in df.select(text.lexical(F.col("t"))).collect()][14] == "fi"
    shown = plan(found.select("has0", "has3"))
    assert f"RLIKE(t, {text.BEYOND_PROSE})" not in shown and shown.count(r"\A[") >= 2


def test_normal_form_of_templates(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", "\r\n|\r", "\n"), r"\A[\s\x1C-\x1F\x85\p{Z}&&[^\x{200B}]]+|[\s\x1C-\x1F\x85\p{Z}&&[^\x{200B}]]+\z", "")
    assert df.where(~text.normalized_template(F.col("t")).eqNullSafe(plain)).count() == 0


def test_equal_texts_are_parsed_once(spark, tmp_path):
    """By batch: every parse leaves a line in a file."""
    log = str(tmp_path / "parsed")

    def parse(value):
        with open(log, "a") as f:
            f.write("x\n")
        return {"n": len(value)} if value else None

    df = spark.createDataFrame([("ab",), (None,), ("ab",), ("c",), ("ab",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(json_facts._udf(parse, "n int")("t")).collect()]
    assert [(r["n"], r["ok"]) for r in got] == [(2, True), (None, False), (2, True), (1, True), (2, True)]
    assert len(open(log).readlines()) == 3
