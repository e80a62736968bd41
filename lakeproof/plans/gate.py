"""Corpus gate: which template FAIL rules hit in which repositories, resumable, and its statistics; all as joins and aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.functions import fixed
from lakeproof.functions.rules import FAIL_TEMPLATE_RULES
from lakeproof.operators.metadata import architecture, current
from lakeproof.operators.templates import source_findings
from lakeproof.sources.staging import written

INVENTORY = "repo string, bundle_files array<string>, gguf_files array<string>, chat_template string"
STATUSES = ["analyzed", "no_template", "no_gguf", "error"]
BUNDLE_NAMES = [*fixed.BUNDLE_CONFIGS, "tokenizer.json", "special_tokens_map.json", "added_tokens.json", "tokenizer_config.json", "processor_config.json", "chat_template.jinja", "README.md"]


def resolve_target(target: Column, filename: Column | None = None, host: str = "https://huggingface.co") -> Column:
    """A URL for a URL, an ``hf://`` address or a repository id with a file name; null where no file can be told."""
    bare = F.regexp_replace(target, "^hf://", "")
    parts = F.split(bare, "/")
    repo = F.concat_ws("/", F.slice(parts, 1, 2))
    inside = F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(1)))))
    file = F.coalesce(filename, inside) if filename is not None else inside
    return F.when(target.rlike("^https?://"), target).when(file.isNotNull(), F.concat(F.lit(host + "/"), repo, F.lit("/resolve/main/"), file))


def pick_file(names: Column) -> Column:
    """One model file of a list: no projector; whole files first, the shortest name of them, in the list's order; else a first part; else the first."""
    kept = F.filter(names, lambda n: F.lower(n).endswith(".gguf") & ~F.lower(n).contains("mmproj"))
    rank = lambda n: F.when(~n.contains("-of-"), 0).when(n.contains("00001-of"), 1).otherwise(2)
    keyed = F.transform(kept, lambda n, i: F.struct(rank(n).alias("rank"), F.when(rank(n) == 0, F.length(n)).otherwise(0).alias("length"), i.alias("at"), n.alias("name")))
    return F.array_min(keyed)["name"]


_CATALOGUE = "array<struct<id: string, siblings: array<struct<rfilename: string>>, gguf: struct<chat_template: string>>>"


def inventory_of(pages: DataFrame) -> DataFrame:
    """The inventory of saved catalogue pages (url, next_url, body: a JSON list of repositories); a page that two others lead to is an error."""
    body = F.from_json("body", _CATALOGUE)
    back = pages.where("next_url is not null").groupBy("next_url").agg(F.count("*").alias("n")).where("n > 1").select(F.col("next_url").alias("url"))
    looped = pages.select("url").where("url is not null").groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url").unionByName(back)
    loop = looped.agg(F.min("url").alias("loop")).scalar()
    each = pages.select(F.when(loop.isNotNull(), F.raise_error(F.concat(F.lit("the catalogue leads back to "), loop))).otherwise(body).alias("b"))
    m = each.select(F.explode("b").alias("m")).where("m.id is not null")
    names = F.coalesce(F.array_compact(F.col("m.siblings.rfilename")), F.array().cast("array<string>"))
    models = F.filter(names, lambda n: F.lower(n).endswith(".gguf") & ~F.lower(n).contains("mmproj"))
    known = F.array(*[F.lit(n) for n in BUNDLE_NAMES])
    return m.select(F.col("m.id").alias("repo"), F.array_sort(F.array_intersect(names, known)).alias("bundle_files"), F.array_sort(models).alias("gguf_files"), F.col("m.gguf.chat_template").alias("chat_template"))


def unique_inventory(inventory: DataFrame) -> DataFrame:
    """The inventory, or an error where a repository is listed twice."""
    n = inventory.groupBy("repo").agg(F.count("*").alias("n"), F.first("bundle_files").alias("bundle_files"), F.first("gguf_files").alias("gguf_files"), F.first("chat_template").alias("chat_template"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("listed twice: "), "repo"))).otherwise(F.col("repo"))
    return n.select(checked.alias("repo"), F.array_intersect("bundle_files", F.array(*[F.lit(x) for x in BUNDLE_NAMES])).alias("bundle_files"), "gguf_files", "chat_template")


def gate(inventory: DataFrame, processed: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """One row per repository that isn't in ``processed`` (repo): repo, status, source, file, error, hits.

    Inline templates are scanned as they are. Where there is none, ``headers`` (repo, template, error) holds what the picked file's header gave; repositories
    without a model file are no_gguf, and without a header row no_template.
    """
    todo = inventory if processed is None else inventory.join(processed.select("repo").distinct(), "repo", "left_anti")
    todo = todo.withColumn("file", pick_file(F.col("gguf_files"))).withColumn("inline", F.when(F.trim(F.coalesce("chat_template", F.lit(""))) != "", F.col("chat_template")))
    if headers is None:
        headers = inventory.sparkSession.createDataFrame([], "repo string, template string, error string")
    todo = todo.join(headers.select("repo", F.col("template").alias("header_template"), F.col("error").alias("header_error")), "repo", "left")
    source = F.coalesce("inline", "header_template")
    status = F.when(source.isNotNull(), "analyzed").when(F.col("file").isNull(), "no_gguf").when(F.col("header_error").isNotNull(), "error").otherwise("no_template")
    todo = todo.withColumn("template", source).withColumn("status", status)
    some = todo.where("template is not null").select(F.col("repo").alias("model_id"), F.lit("default").alias("variant"), F.col("template").alias("source"))
    hits = source_findings(some).where(F.col("rule_id").isin(*FAIL_TEMPLATE_RULES)).groupBy("model_id").agg(F.array_sort(F.collect_list("rule_id")).alias("hits"))
    out = todo.join(hits, todo["repo"] == hits["model_id"], "left")
    where = F.when(F.col("inline").isNotNull(), "inline").when(F.col("header_template").isNotNull(), "header")
    return out.select("repo", "status", where.alias("source"), "file", F.when(F.col("status") == "error", F.col("header_error")).alias("error"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))


def gate_statistics(results: DataFrame) -> DataFrame:
    """One row: counts by status and source, findings, flagged repositories, and shares of the repositories, rounded half to even."""
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda c: F.bround(100.0 * c / n, 4)
    by = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return results.agg(
        F.count("*").alias("n_repos"), *by, F.count_if(F.col("source") == "inline").alias("n_inline"), F.count_if(F.col("source") == "header").alias("n_header"),
        F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("n_findings"), F.count_if(F.size("hits") > 0).alias("n_flagged"),
        share(F.count_if(F.col("status").isin("analyzed", "no_template"))).alias("parsed_pct"), share(F.count_if(F.col("status") == "analyzed")).alias("analyzed_pct"),
    )


def rule_counts(results: DataFrame) -> DataFrame:
    """(rule_id, n): hits of each template FAIL rule, none left out."""
    every = results.sparkSession.createDataFrame([(r,) for r in FAIL_TEMPLATE_RULES], "rule_id string")
    counts = results.select(F.explode("hits").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "rule_id", "left").na.fill({"n": 0})


def hit_list(results: DataFrame, most: int | None = None) -> DataFrame:
    """Repositories with hits, by name; the first ``most`` of them if that is given."""
    listed = results.where(F.size("hits") > 0).select("repo", "source", "file", F.array_sort("hits").alias("hits")).orderBy("repo")
    return listed if most is None else listed.limit(most)


def exclusions(results: DataFrame, most: int | None = None) -> DataFrame:
    """Repositories that could not be judged and why, by name; the first ``most`` of them if that is given."""
    listed = results.where("status in ('error', 'no_gguf')").select("repo", "status", "file", "error").orderBy("repo")
    return listed if most is None else listed.limit(most)


def corpus_rows(models: DataFrame, metadata: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a model that was read: model_id, arch, has_template, n_fail, n_warn, rules, fails, behavioural (its rules TPL020 to TPL029), each list sorted."""
    kept = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("rule_id"))))
    found = findings.groupBy("model_id").agg(
        F.count_if(F.col("severity") == "FAIL").alias("n_fail"), F.count_if(F.col("severity") == "WARN").alias("n_warn"), kept(F.lit(True)).alias("rules"), kept(F.col("severity") == "FAIL").alias("fails"),
        kept(F.col("rule_id").startswith("TPL02")).alias("behavioural"),
    )
    template = current(metadata.where(F.col("key") == fixed.TEMPLATE_KEY)).where("v_str is not null").select("model_id", F.lit(True).alias("has_template"))
    out = models.where("parse_error is null").select("model_id").join(architecture(metadata), "model_id", "left").join(template, "model_id", "left").join(found, "model_id", "left")
    none = F.array().cast("array<string>")
    return out.select("model_id", "arch", F.coalesce("has_template", F.lit(False)).alias("has_template"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fail", "n_warn")], *[F.coalesce(c, none).alias(c) for c in ("rules", "fails", "behavioural")])


def corpus_summary(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: models read, with templates, skipped, with failures, with behavioural flags and their share of those with templates, and distinct architectures."""
    flagged, with_template = F.count_if(F.size("behavioural") > 0), F.count_if("has_template")
    counts = rows.agg(
        F.count("*").alias("n_scanned"), with_template.alias("n_with_template"), F.count_if(F.col("n_fail") > 0).alias("n_with_fail"), flagged.alias("n_behavioural"),
        F.bround(100.0 * flagged / F.greatest(with_template, F.lit(1)), 3).alias("behavioural_pct"), F.count_distinct("arch").alias("n_architectures"),
    )
    return counts.withColumn("n_skipped", skipped.agg(F.count("*").alias("n")).scalar())


def rule_histogram(findings: DataFrame) -> DataFrame:
    """(rule_id, n_models): models on which each rule fires, the commonest first."""
    return findings.groupBy("rule_id").agg(F.count_distinct("model_id").alias("n_models")).orderBy(F.desc("n_models"), "rule_id")


def recall(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Of labelled payloads (model_id, class: bad, benign or gap): how many, and how many have a FAIL or WARN finding."""
    alarmed = findings.where(F.col("severity").isin("FAIL", "WARN")).select("model_id").distinct().withColumn("caught", F.lit(True))
    return expected.join(alarmed, "model_id", "left").groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.coalesce("caught", F.lit(False))).alias("n_caught"))


def pinned(spark: SparkSession, path: str, pins: dict[str, str]) -> None:
    """Write down what a run is bound to, or stop if the results at ``path`` were bound to something else."""
    now = spark.createDataFrame(sorted(pins.items()), "pin string, value string")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/pins")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        old = {r["pin"]: r["value"] for r in spark.read.parquet(f"{path}/pins").collect()}
        if old != pins:
            raise ValueError(f"results at {path} belong to another run: {sorted(k for k in {*old, *pins} if old.get(k) != pins.get(k))}")
        return
    now.coalesce(1).write.parquet(f"{path}/pins")


def header_templates(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """(repo, template, error) of model files' headers, as :func:`gate` takes them."""
    own = current(metadata.where(F.col("key") == fixed.TEMPLATE_KEY)).where("v_str is not null").select("model_id", F.col("v_str").alias("template"))
    return models.join(own, "model_id", "left").select(F.col("model_id").alias("repo"), "template", F.col("parse_error").alias("error"))


def to_fetch(inventory: DataFrame, host: str = "https://huggingface.co") -> DataFrame:
    """(repo, file, url) of the model files whose headers tell what an inventory doesn't: those of repositories without an inline template."""
    bare = inventory.where(F.trim(F.coalesce("chat_template", F.lit(""))) == "").select("repo", pick_file(F.col("gguf_files")).alias("file")).where("file is not null")
    return bare.select("repo", "file", resolve_target(F.col("repo"), F.col("file"), host).alias("url"))


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders under ``path`` whose writing was finished, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    inside = [f.getPath() for f in files.listStatus(folder) if f.isDirectory()]
    return sorted(f.toString() for f in inside if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


#: Repositories in a lot, about.
LOT_ROWS = 10_000


def run_gate(
    inventory: DataFrame, path: str, pins: dict[str, str], headers: DataFrame | None = None, most: int | None = None, lot_rows: int = LOT_ROWS, fetch: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Gate what isn't done yet and give all results that are at ``path``. A run that broke off is taken up at the lot where it stood.

    The repositories that are left are dealt by a hash of their names into lots of about ``lot_rows``, each with a folder of its own under ``path``/results that counts once
    its writing is finished; what an unfinished lot left is never read. So a run that is stopped repeats one lot at most. ``fetch`` takes a lot's inventory and gives its
    headers (repo, template, error), in place of ``headers`` for all; a lot is then what is fetched again. With ``most`` only the first so many repositories by name are
    gated, for a trial run. A repository that is listed twice is an error before anything is gated.
    """
    if most is not None:
        inventory = inventory.orderBy("repo").limit(most)
    spark = inventory.sparkSession
    pinned(spark, path, pins)
    results, shape = f"{path}/results", "repo string, status string, source string, file string, error string, hits array<string>"
    done = committed(spark, results)
    seen = spark.read.schema(shape).parquet(*done) if done else spark.createDataFrame([], shape)
    left = written(unique_inventory(inventory).join(seen.select("repo"), "repo", "left_anti"), "todo")
    n_left = left.count()
    n = -(-n_left // lot_rows)
    in_lots = written(left.withColumn("lot", F.pmod(F.xxhash64("repo"), F.lit(n)).cast("int")), "lots", "lot") if n else left
    for lot in range(n):
        part = in_lots.where(F.col("lot") == lot).drop("lot")
        told = headers if fetch is None else fetch(part)
        gate(part, None, told).select(*[c.split()[0] for c in shape.split(", ")]).write.parquet(f"{results}/{len(done):08d}-{lot:08d}-{uuid.uuid4().hex}")
    now = committed(spark, results)
    return spark.read.schema(shape).parquet(*now) if now else seen
