"""Tokenizer arrays against one another, the special ids and the tensors; and the deep pass over role marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.functions import fixed
from lakeproof.operators.findings import hit, shuffled, union
from lakeproof.operators.metadata import current, named, shards

PHASE = 30
_ROOT = "tokenizer.ggml."


def vocabulary(metadata: DataFrame) -> DataFrame:
    """(model_id, vocab, longest): length of the token array."""
    now = current(metadata.where(F.col("key") == _ROOT + "tokens")).where("arr is not null")
    return now.select("model_id", F.col("arr.length").alias("vocab"), F.col("arr.max_elem_bytes").alias("longest"), F.col("arr").alias("tokens"))


def tokenizer_findings(metadata: DataFrame, tensors: DataFrame, deep: bool = False) -> DataFrame:
    """TOK001 to TOK005, and with ``deep`` TOK012 and TOK015 where both arrays were read whole."""
    now = current(metadata.where(F.col("key").startswith(_ROOT)))
    vocab = vocabulary(metadata)
    sizes = shuffled(vocab.select("model_id", "vocab", "longest"))
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    nth = F.array_position(F.array(*[F.lit(_ROOT + k) for k in fixed.SPECIAL_IDS]), F.col("key"))
    ids = now.where(F.col("key").isin(*[_ROOT + k for k in fixed.SPECIAL_IDS])).where("v_int is not null").where(~F.col("v_int").isin(*fixed.UNSET_IDS))
    outside = ids.join(sizes, "model_id").where("v_int < 0 or v_int >= vocab")
    tables = named(tensors, "token_embd.weight", "output.weight").where(F.size("shape") > 0).join(shuffled(shards(metadata)), "model_id", "left_anti")
    wide = tables.join(sizes, "model_id").where(F.col("vocab") > F.array_max("shape"))
    side = now.where(F.col("key").isin(_ROOT + "scores", _ROOT + "token_type")).where("arr is not null").join(sizes, "model_id").where("arr.length <> vocab")
    kinds = now.where(F.col("key") == _ROOT + "token_type").withColumn("bad", F.array_sort(F.array_distinct(F.filter("arr.preview_int", lambda v: ~v.between(1, 6))))).where(F.size("bad") > 0)
    long = vocab.where(F.col("longest") > fixed.LONG_TOKEN)
    flags = now.where(F.col("key").isin(_ROOT + "add_bos_token", _ROOT + "add_eos_token") & F.col("v_bool"))
    flags = flags.select("model_id", "key", F.regexp_replace("key", "add_(...)_token", "$1_token_id").alias("id_key"))
    valued = now.select("model_id", F.col("key").alias("id_key"), F.col("v_int").alias("id"))
    good = F.col("id").isNotNull() & ~F.col("id").isin(*fixed.UNSET_IDS) & (F.col("id") >= 0) & (F.col("vocab").isNull() | (F.col("id") < F.col("vocab")))
    lost = flags.join(shuffled(valued), ["model_id", "id_key"], "left").join(sizes, "model_id", "left").where(~F.coalesce(good, F.lit(False)))
    parts = [
        outside.select(*hit("TOK001", PHASE, nth, say(F.col("key"), " = ", F.col("v_int"), " of ", F.col("vocab"), " tokens"), F.col("key"))),
        wide.select(*hit("TOK002", PHASE + 1, F.when(F.col("name") == "output.weight", 1).otherwise(0), say(F.col("vocab"), " tokens, ", F.col("name"), " ", F.to_json("shape")), F.lit(_ROOT + "tokens"))),
        side.select(*hit("TOK003", PHASE + 2, F.when(F.col("key").endswith("scores"), 0).otherwise(1), say(F.col("key"), " has ", F.col("arr.length"), " entries for ", F.col("vocab"), " tokens"), F.col("key"))),
        kinds.select(*hit("TOK003", PHASE + 2, F.lit(2), say("unknown kinds ", F.to_json(F.slice("bad", 1, 8))), F.lit(_ROOT + "token_type"))),
        long.select(*hit("TOK004", PHASE + 3, F.lit(0), say("a token of ", F.col("longest"), " bytes", F.when(F.col("longest") > fixed.INT32_MAX, " (beyond signed 32 bits)").otherwise("")), F.lit(_ROOT + "tokens"))),
        lost.select(*hit("TOK005", PHASE + 4, F.when(F.col("key").contains("bos"), 0).otherwise(1), say(F.col("key"), " is set, ", F.col("id_key"), " is not usable"), F.col("key"))),
    ]
    return union(parts + ([seam_findings(metadata)] if deep else []))


def seam_findings(metadata: DataFrame) -> DataFrame:
    """Role marks among the special tokens: forms that look alike (TOK012) and how many there are (TOK015)."""
    kinds = current(metadata.where(F.col("key") == _ROOT + "token_type")).where("arr is not null and not arr.truncated").select("model_id", F.col("arr.preview_int").alias("kinds"))
    both = vocabulary(metadata).where("not tokens.truncated").select("model_id", F.coalesce("tokens.preview_str", F.array().cast("array<string>")).alias("surfaces")).join(shuffled(kinds), "model_id")
    n = F.least(F.size("surfaces"), F.size("kinds"))
    pairs = F.slice(F.arrays_zip("surfaces", "kinds"), F.lit(1), n)
    each = both.select("model_id", F.explode_outer(pairs).alias("p")).select("model_id", F.col("p.surfaces").alias("s"), F.col("p.kinds").alias("kind"))
    special = F.col("kind").isin(3, 4)
    role = F.col("s").rlike(rf"\A(?:{fixed.ROLE_MARK})\z")
    skeleton = F.translate("s", fixed.PIPES + "▁", "|" * len(fixed.PIPES) + "_")
    noise = F.lower(F.regexp_replace("s", r"\A[<>\[\]|｜ ▁]+|[<>\[\]|｜ ▁]+\z", "")).isin(*fixed.NOISE_WORDS) | F.col("s").rlike(r"\A\s*\z")
    forms = each.where(special & role).select("model_id", "s", skeleton.alias("skeleton")).distinct()
    alike = forms.groupBy("model_id", "skeleton").agg(F.array_sort(F.collect_set("s")).alias("forms")).where(F.size("forms") >= 2)
    order = F.xxhash64("skeleton")
    counts = each.groupBy("model_id").agg(
        F.count_distinct(F.when(special & role & ~noise, F.col("s"))).alias("marks"), F.count_distinct("s").alias("vocab"), F.count_if(F.col("s").isNotNull() & (F.col("kind") == 3)).alias("control"))
    where = F.lit(_ROOT + "tokens")
    found = alike.select(*hit("TOK012", PHASE + 5, order, F.concat(F.lit("forms of "), F.col("skeleton"), F.lit(": "), F.array_join("forms", " ")), where))
    return found.unionByName(counts.select(*hit("TOK015", PHASE + 6, F.lit(0), F.concat(F.col("marks").cast("string"), F.lit(" role marks among "), F.col("vocab").cast("string"), F.lit(" tokens, "), F.col("control").cast("string"), F.lit(" of them control")), where)))
