"""The findings contract: joined to the registry, deduplicated, ordered, counted and judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.functions.rules import FAIL, INFO, WARN, rules

RAW = ["model_id", "phase", "seq", "rule_id", "detail", "location"]


def hit(rule_id: str, phase: int, seq: Column, detail: Column, location: Column, model_id: str = "model_id") -> list[Column]:
    """Columns of a raw finding; phase and seq keep the order in which equal ones appear."""
    return [F.col(model_id).alias("model_id"), F.lit(phase).alias("phase"), seq.cast("long").alias("seq"), F.lit(rule_id).alias("rule_id"), detail.cast("string").alias("detail"), location.cast("string").alias("location")]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that has rows in proportion to the models: merged by key, never broadcast.

    Sizes guessed from compressed files would send it whole to the driver long after it outgrew it.
    """
    return df.hint("merge")


def with_registry(raw: DataFrame) -> DataFrame:
    """Severity and title from the registry alone; an unknown rule stops the query."""
    known = F.broadcast(rules(raw.sparkSession).select("rule_id", "severity", "title"))
    joined = raw.join(known, "rule_id", "left")
    severity = F.when(F.col("severity").isNull(), F.raise_error(F.concat(F.lit("unregistered rule "), "rule_id"))).otherwise(F.col("severity"))
    return joined.select("model_id", "phase", "seq", "rule_id", severity.alias("severity"), "title", "detail", "location")


def deduplicated(raw: DataFrame, *keys: str) -> DataFrame:
    """The first of equal findings (rule, location, detail) of a model."""
    by = Window.partitionBy("model_id", *keys, "rule_id", "location", "detail").orderBy("phase", "seq")
    return raw.withColumn("nth_", F.row_number().over(by)).where("nth_ = 1").drop("nth_")


def rank(severity: Column) -> Column:
    return F.when(severity == FAIL, 0).when(severity == WARN, 1).otherwise(2)


def final_order() -> list[Column]:
    """What a model's findings are put in order by."""
    return [rank(F.col("severity")), F.col("rule_id"), F.coalesce("location", F.lit("")), F.col("phase"), F.col("seq")]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("model_id", *final_order())


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with their place within their model, from 1."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("model_id").orderBy(*final_order())).cast("long"))


def severity_summary(findings: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Counts of each severity by model, and the verdict; with ``models`` also those without findings."""
    counts = findings.groupBy("model_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in (FAIL, WARN, INFO)])
    if models is not None:
        counts = models.select("model_id").distinct().join(counts, "model_id", "left").na.fill(0)
    return counts.withColumn("verdict", verdict(F.col("n_fail"), F.col("n_warn")))


def verdict(n_fail: Column, n_warn: Column) -> Column:
    return F.when(n_fail > 0, "FAIL").when(n_warn > 0, "REVIEW").otherwise("PASS")


def exit_code(n_fail: Column, n_warn: Column, fail_on: str = "fail") -> Column:
    """1 for warnings where they count, 2 for failures, else 0."""
    return F.when(n_fail > 0, 2).when((n_warn > 0) & F.lit(fail_on == "warn"), 1).otherwise(0)
