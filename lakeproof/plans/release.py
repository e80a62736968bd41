"""Two-step release gate: rules over repositories' small files first, and model headers only of those that force tokens which no file spells out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.functions import fixed
from lakeproof.operators import bundle
from lakeproof.operators.findings import union
from lakeproof.operators.templates import source_findings
from lakeproof.plans.gate import pick_file, resolve_target
from lakeproof.sources.staging import written

HITS = "array<struct<rule_id: string, detail: string, location: string>>"


def texts_to_fetch(inventory: DataFrame, host: str = "https://huggingface.co") -> DataFrame:
    """(repo, file, url, most) of the small files that an inventory lists, each with its limit of bytes."""
    limit = F.lit(bundle.MOST_OTHER)
    for name, most in bundle.MOST_BYTES.items():
        limit = F.when(F.col("file") == name, most).otherwise(limit)
    some = inventory.select("repo", F.explode(F.array_intersect("bundle_files", F.array(*[F.lit(n) for n in fixed.RELEASE_FILES]))).alias("file"))
    return some.select("repo", "file", resolve_target(F.col("repo"), F.col("file"), host).alias("url"), limit.alias("most"))


def forcing(repo_files: DataFrame) -> DataFrame:
    """(model_id) of the repositories whose configuration has a key that forces tokens, whatever its value."""
    configs = bundle.files(repo_files, *fixed.BUNDLE_CONFIGS)
    return configs.where(F.arrays_overlap(F.json_object_keys("text"), F.array(*[F.lit(k) for k in fixed.FORCED_KEYS]))).select("model_id").distinct()


def release_gate(inventory: DataFrame, texts: DataFrame, headers: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row per repository: repo, hits (of the release rules, in order), errors, header_fallback.

    ``inventory`` lists each repository once (repo, bundle_files, gguf_files, chat_template), ``texts`` is what came of its files (repo, file, status, text, error), as
    :func:`lakeproof.sources.fetch.fetched_texts` gives it. ``headers`` is asked once, for the (repo, file) of the second step: repositories whose configuration forces tokens and
    whose tokenizer file gives no surfaces; it gives (models, metadata) with the tokens whole and model_id the repository. Files that couldn't be had, headers that couldn't
    be read and repositories without any model file are errors of their repository, beside whatever else it shows. An empty inventory gives an empty result.
    """
    files = written(texts.where("status = 'ok'").select(F.col("repo").alias("model_id"), F.col("file").alias("file_name"), "text"), "files")
    failed = texts.where("status <> 'ok'").select("repo", F.concat("file", F.lit(": "), F.coalesce("error", "status")).alias("error"))

    spelt = written(bundle.file_surfaces(files), "surfaces")
    second = forcing(files).join(spelt.select("model_id"), "model_id", "left_anti").withColumnRenamed("model_id", "repo")
    second = written(inventory.select("repo", "gguf_files").join(second, "repo", "left_semi").select("repo", pick_file(F.col("gguf_files")).alias("file")), "second")
    models, metadata = headers(second.where("file is not null"))
    unread = models.where("parse_error is not null").select(F.col("model_id").alias("repo"), F.concat(F.lit("header of "), F.coalesce("path", F.lit("the model file")), F.lit(": "), "parse_error").alias("error"))
    without = second.where("file is null").select("repo", F.lit("forced tokens are spelt by no tokenizer file and no model file").alias("error"))

    vocab = union([spelt, bundle.surfaces(metadata)])
    inline = inventory.where("chat_template is not null").select(F.col("repo").alias("model_id"), F.lit("default").alias("variant"), F.col("chat_template").alias("source"))
    found = union([source_findings(inline).drop("variant"), bundle.bundle_findings(files, metadata, vocab)]).where(F.col("rule_id").isin(*fixed.RELEASE_RULES))
    hit = F.struct("phase", "seq", "rule_id", "detail", "location")
    shown = F.transform(F.array_sort(F.collect_list(hit)), lambda h: F.struct(h["rule_id"].alias("rule_id"), h["detail"].alias("detail"), h["location"].alias("location")))
    hits = found.groupBy(F.col("model_id").alias("repo")).agg(shown.alias("hits"))
    errors = union([failed, unread, without]).groupBy("repo").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    fell_back = models.where("parse_error is null").select(F.col("model_id").alias("repo"), F.lit(True).alias("header_fallback"))

    out = inventory.select("repo").join(hits, "repo", "left").join(errors, "repo", "left").join(fell_back, "repo", "left")
    empty = {"hits": F.array().cast(HITS), "errors": F.array().cast("array<string>"), "header_fallback": F.lit(False)}
    return out.select("repo", *[F.coalesce(c, other).alias(c) for c, other in empty.items()])


def release_statistics(results: DataFrame) -> DataFrame:
    """One row: repositories, those without and with errors, header fallbacks, hits, repositories with hits."""
    return results.agg(
        F.count("*").alias("n_repos"), F.count_if(F.size("errors") == 0).alias("n_successful"), F.count_if(F.size("errors") > 0).alias("n_with_errors"), F.count_if("header_fallback").alias("n_header_fallbacks"),
        F.coalesce(F.sum(F.size("hits")), F.lit(0)).cast("long").alias("n_hits"), F.count_if(F.size("hits") > 0).alias("n_flagged"),
    )


def release_rule_counts(results: DataFrame) -> DataFrame:
    """(rule_id, n): hits of each release rule, none left out."""
    every = results.sparkSession.createDataFrame([(r,) for r in fixed.RELEASE_RULES], "rule_id string")
    counts = results.select(F.explode("hits.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "rule_id", "left").na.fill({"n": 0})
