"""Manifests and differences as full outer joins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lakeproof.functions import fixed, text
from lakeproof.operators.findings import hit, shuffled, union
from lakeproof.operators.metadata import current

PHASE = 50


def serialized(metadata: DataFrame) -> DataFrame:
    """(model_id, key, value): current values as text, arrays as ``<array:type[length]>``, without the template."""
    a = F.col("arr")
    value = F.when(a.isNotNull(), F.concat(F.lit("<array:"), a["elem_type"], F.lit("["), a["length"].cast("string"), F.lit("]>"))).otherwise(
        F.coalesce("v_str", F.col("v_int").cast("string"), F.col("v_double").cast("string"), F.col("v_bool").cast("string")))
    return current(metadata).where(F.col("key") != fixed.TEMPLATE_KEY).select("model_id", "key", F.concat("vtype", F.lit(":"), value).alias("value"))


def tensor_map(tensors: DataFrame) -> DataFrame:
    """(model_id, key, value): shape and type of each tensor; offsets don't count."""
    last = tensors.groupBy("model_id", "name").agg(F.max_by(F.struct("shape", "dtype"), "ord").alias("t"))
    return last.select("model_id", F.col("name").alias("key"), F.to_json(F.struct("t.shape", "t.dtype")).alias("value"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows of a full outer join that differ: keys, change (added, removed, changed), old_value, new_value."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    both = a.join(shuffled(b), keys, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "old_value", "new_value")


def templates_of(metadata: DataFrame) -> DataFrame:
    return current(metadata.where(F.col("key") == fixed.TEMPLATE_KEY)).where("v_str is not null").select("model_id", F.col("v_str").alias("source"), text.template_sha256(F.col("v_str")).alias("template_sha256"))


def manifest(models: DataFrame, metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """(model_id, manifest): one JSON object a model with file_sha256, template_sha256, metadata and tensors, keys sorted."""
    as_map = lambda df, name: df.groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))
    out = models.select("model_id", F.col("sha256").alias("file_sha256")).join(shuffled(templates_of(metadata).select("model_id", "template_sha256")), "model_id", "left")
    out = out.join(shuffled(as_map(serialized(metadata), "metadata")), "model_id", "left").join(shuffled(as_map(tensor_map(tensors), "tensors")), "model_id", "left")
    return out.select("model_id", F.to_json(F.struct("file_sha256", "template_sha256", "metadata", "tensors"), {"ignoreNullFields": "false"}).alias("manifest"))


def read_manifest(manifests: DataFrame) -> DataFrame:
    schema = "file_sha256 string, template_sha256 string, metadata map<string,string>, tensors map<string,string>"
    return manifests.select("model_id", F.from_json("manifest", schema).alias("m")).select("model_id", "m.*")


def manifest_findings(expected: DataFrame, models: DataFrame, metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """INT001 to INT004 against :func:`read_manifest`; an expected hash that is null isn't checked for the file, but is for the template.

    Models are to be read with their hashes: a file without one is told as one that isn't as expected.
    """
    has = shuffled(expected.select("model_id"))
    file = expected.join(shuffled(models.select("model_id", "sha256")), "model_id").where("file_sha256 is not null and not file_sha256 <=> sha256")
    template = expected.select("model_id", F.col("template_sha256").alias("want")).join(shuffled(templates_of(metadata)), "model_id", "left").where(~F.col("want").eqNullSafe(F.col("template_sha256")))
    entries = lambda name: expected.select("model_id", F.explode(name).alias("key", "value"))
    meta = changes(entries("metadata"), serialized(metadata).join(has, "model_id", "left_semi"), ["model_id", "key"])
    maps = changes(entries("tensors"), tensor_map(tensors).join(has, "model_id", "left_semi"), ["model_id", "key"])
    say = F.concat(F.col("key"), F.lit(" was "), F.col("change"))
    order = F.xxhash64("key")
    return union([
        file.select(*hit("INT001", PHASE, F.lit(0), F.concat(F.lit("expected "), "file_sha256", F.when(F.col("sha256").isNull(), ", but the file was not hashed").otherwise("")), F.lit(None))),
        template.select(*hit("INT002", PHASE + 1, F.lit(0), F.concat(F.lit("expected "), F.coalesce("want", F.lit("no template"))), F.lit(fixed.TEMPLATE_KEY))),
        meta.select(*hit("INT003", PHASE + 2, order, say, F.col("key"))),
        maps.select(*hit("INT004", PHASE + 3, order, say, F.col("key"))),
    ])


@F.pandas_udf(ArrayType(StringType()))
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines of a unified diff of two texts."""
    return pd.Series([list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "a", "b", lineterm="")) for a, b in zip(old, new)])


def compare(a: tuple[DataFrame, DataFrame, DataFrame], b: tuple[DataFrame, DataFrame, DataFrame]) -> dict[str, DataFrame]:
    """Differences of two models, each (models, metadata, tensors): metadata, template (changed, diff), tensors; model ids don't count."""
    bare = lambda df: df.drop("model_id")
    one = lambda m: m.groupBy().agg(F.max("source").alias("source"))
    empty: Column = F.coalesce("source", F.lit(""))
    left, right = one(templates_of(a[1])).select(empty.alias("old")), one(templates_of(b[1])).select(empty.alias("new"))
    pair = left.join(right)  # one row each
    template = pair.select((text.normalized_template(F.col("old")) != text.normalized_template(F.col("new"))).alias("changed"), unified_diff("old", "new").alias("diff"))
    return {
        "metadata": changes(bare(serialized(a[1])), bare(serialized(b[1])), ["key"]),
        "template": template,
        "tensors": changes(bare(tensor_map(a[2])), bare(tensor_map(b[2])), ["key"]),
    }
