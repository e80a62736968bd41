"""Structural and provenance rules over tensors: sizes, bounds, overlaps, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.functions import fixed
from lakeproof.operators.findings import hit, shuffled, union
from lakeproof.operators.metadata import scalar

PHASE = 40
_WIDE = "decimal(38,0)"


def tensor_types(spark) -> DataFrame:
    """The table of known types: 36 rows, always broadcast."""
    return spark.createDataFrame([t for t in fixed.TENSOR_TYPES], "known_id bigint, type_name string, block_size int, type_size int")


def _product(dims: Column) -> Column:
    """Product of dimensions; null if it leaves 38 digits, 0 if any is 0."""
    whole = F.aggregate(dims, F.lit(1).cast(_WIDE), lambda a, d: F.try_multiply(a, d.cast(_WIDE)).cast(_WIDE))
    return F.when(F.exists(dims, lambda d: d == 0), F.lit(0).cast(_WIDE)).otherwise(whole)


def sized(tensors: DataFrame) -> DataFrame:
    """Tensors with block_size, type_size, known, n_elements and n_bytes (null: unknown layout), and too_big."""
    known = F.broadcast(tensor_types(tensors.sparkSession))
    t = tensors.join(known, tensors["type_id"] == known["known_id"], "left").drop("known_id")
    laid_out = F.col("block_size").isNotNull() & F.col("type_size").isNotNull()
    first = F.get("shape", F.lit(0)).cast(_WIDE)
    row = F.floor(F.try_divide(F.try_multiply(first, F.col("type_size").cast(_WIDE)), F.col("block_size").cast(_WIDE))).cast(_WIDE)
    rest = _product(F.slice("shape", F.lit(2), F.greatest(F.size("shape"), F.lit(1))))
    n_bytes = F.when(F.size("shape") == 0, F.col("type_size").cast(_WIDE)).otherwise(F.when((row == 0) | (rest == 0), F.lit(0).cast(_WIDE)).otherwise(F.try_multiply(row, rest).cast(_WIDE)))
    t = t.withColumn("n_elements", _product(F.col("shape"))).withColumn("n_bytes", F.when(laid_out, n_bytes))
    limit = F.lit(fixed.INT63_MAX).cast(_WIDE)
    too_big = F.col("n_elements").isNull() | (F.col("n_elements") > limit) | (laid_out & (F.col("n_bytes").isNull() | (F.col("n_bytes") > limit)))
    return t.withColumn("too_big", F.coalesce(too_big, F.lit(False))).withColumn("unsized", laid_out & F.col("n_bytes").isNull()).withColumn("known", F.col("type_name").isNotNull())


def overlaps(regions: DataFrame, model: str = "model_id") -> DataFrame:
    """Neighbouring regions (start, end, name) of a model, in that order, of which the second begins before the first ends."""
    by = Window.partitionBy(model).orderBy("start", "end", "name")
    before = regions.withColumn("prev_end", F.lag("end").over(by)).withColumn("prev_name", F.lag("name").over(by)).withColumn("nth", F.row_number().over(by))
    return before.where(F.col("start") < F.col("prev_end"))


def read_whole(models: DataFrame) -> DataFrame:
    return models.where("parse_error is null and complete")


def placed(models: DataFrame, tensors: DataFrame) -> DataFrame:
    """Sized tensors of models whose file was read whole, with file_size, start, end and the location of their findings."""
    whole = read_whole(models).select("model_id", F.col("file_size").cast(_WIDE).alias("file_size"), F.col("data_start").cast(_WIDE).alias("data_start"))
    t = sized(tensors).join(shuffled(whole), "model_id").withColumn("loc", F.when(F.col("name") == "", "<tensor>").otherwise(F.col("name")))
    return t.withColumn("start", F.col("data_start") + F.col("offset")).withColumn("end", F.try_add("start", "n_bytes"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])


def tensor_findings(t: DataFrame) -> DataFrame:
    """STR001, STR003 and STR006 to STR008 of placed tensors."""
    past = F.col("start") > F.col("file_size")
    beyond = ~past & (F.col("unsized") | (F.col("end") > F.col("file_size")))
    zero = F.exists("shape", lambda d: d == 0)
    uneven = ~zero & (F.col("block_size") > 1) & (F.size("shape") > 0) & (F.get("shape", F.lit(0)) % F.greatest(F.col("block_size"), F.lit(1)) != 0)
    reasons = name_problems(F.col("name"))
    checks = [
        ("STR001", F.col("too_big"), _text("tensor ", F.col("name"), " of shape ", F.to_json("shape"), " does not fit signed 64 bits")),
        ("STR003", past | F.coalesce(beyond, F.lit(False)), _text("tensor ", F.col("name"), " lies at ", F.col("start"), " in a file of ", F.col("file_size"), " bytes")),
        ("STR006", F.coalesce(zero | uneven, F.lit(False)), _text("tensor ", F.col("name"), " has an innermost dimension that its block size ", F.col("block_size"), " does not divide, or a zero")),
        ("STR007", ~F.col("known"), _text("tensor ", F.col("name"), " has the unknown type ", F.col("type_id"))),
        ("STR008", F.size(reasons) > 0, _text("tensor name ", F.col("name"), ": ", F.array_join(reasons, ", "))),
    ]
    each = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule_id"), detail.alias("detail"))) for i, (rule, cond, detail) in enumerate(checks)]))
    return t.select("model_id", "ord", "loc", F.explode(each).alias("f")).select(
        "model_id", F.lit(PHASE + 1).alias("phase"), (F.col("ord").cast("long") * 8 + F.col("f.i")).alias("seq"), "f.rule_id", "f.detail", F.col("loc").alias("location"))


def overlap_findings(t: DataFrame) -> DataFrame:
    """STR004 of placed tensors."""
    shared = overlaps(t.where("n_bytes > 0").select("model_id", "name", "start", "end"))
    return shared.select(*hit("STR004", PHASE + 2, F.col("nth"), _text("tensors ", F.col("prev_name"), " and ", F.col("name"), " share bytes from ", F.col("start")), F.col("name")))


def alignment_findings(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """STR005."""
    raw = metadata_last(metadata.where("key = 'general.alignment'"))
    v = F.col("v_int").cast("bigint")
    sane = F.col("v_int").isNotNull() & F.col("v_int").between(fixed.LEAST_ALIGNMENT, fixed.MOST_ALIGNMENT)
    power = F.when(sane, v.bitwiseAND(v - 1) == 0).otherwise(False)
    shown = F.coalesce(F.col("v_int").cast("string"), F.col("v_str"), F.col("vtype"))
    return raw.join(shuffled(read_whole(models).select("model_id")), "model_id", "left_semi").where(~power).select(*hit("STR005", PHASE, F.lit(0), _text("alignment ", shown), F.lit("general.alignment")))


def structure_findings(models: DataFrame, metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """STR001, STR003 to STR008, INT005, INT006; models whose file wasn't read whole have no STR findings."""
    t = placed(models, tensors)
    return union([alignment_findings(models, metadata), tensor_findings(t), overlap_findings(t), provenance_findings(metadata, tensors)])


def metadata_last(metadata: DataFrame) -> DataFrame:
    from lakeproof.operators.metadata import current

    return current(metadata)


def name_problems(name: Column) -> Column:
    """What is odd about a tensor name, in order."""
    return F.array_compact(F.array(
        F.when(F.octet_length(name) > fixed.LONG_NAME, f"over {fixed.LONG_NAME} bytes"), F.when(name.rlike(r"[\x00-\x1F]"), "control characters"),
        F.when(name.contains("�"), "broken UTF-8"), F.when(name.contains("/") | name.contains("\\") | name.contains(".."), "path characters"),
    ))


def provenance_findings(metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """INT006 for shards; INT005 for tensors named twice, like adapters, or beyond the declared layers."""
    now = metadata_last(metadata)
    shard = now.where("key = 'split.count'").where(F.coalesce(F.col("v_int"), F.col("v_bool").cast("int")) > 1)
    shards = shard.select(*hit("INT006", PHASE + 3, F.lit(0), F.concat(F.lit("one of "), F.col("v_int").cast("string"), F.lit(" parts")), F.lit("split.count")))
    layers = scalar(metadata, "block_count").select("model_id", F.col("value").alias("block_count"))
    nth = F.row_number().over(Window.partitionBy("model_id", "name").orderBy("ord"))
    t = tensors.withColumn("nth", nth).join(shuffled(layers), "model_id", "left")
    name, lower = F.col("name"), F.lower("name")
    index = F.when(name.startswith("blk."), F.expr("try_cast(get(split(name, '[.]'), 1) as decimal(38,0))"))
    why = F.array_compact(F.array(
        F.when(F.col("nth") > 1, "the name is a duplicate"), F.when(lower.contains("lora") | lower.contains("adapter"), "named like an adapter"),
        F.when(index >= F.col("block_count"), "beyond the declared layers"),
    ))
    odd = t.select("model_id", "ord", "name", F.posexplode(why).alias("i", "why"))
    return shards.unionByName(odd.select(*hit("INT005", PHASE + 4, F.col("ord") * 4 + F.col("i"), F.concat(F.lit("tensor "), name, F.lit(": "), F.col("why")), name)))
