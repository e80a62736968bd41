"""The audit as plans: scan, diff, hash, rules; and their renderings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.functions import fixed
from lakeproof.functions.rules import RULES, SEVERITIES
from lakeproof.operators import bundle, integrity, metadata, structure, templates, tokenizer
from lakeproof.operators.findings import ordered, severity_summary, union, with_registry
from lakeproof.plans import gate
from lakeproof.sources import gguf
from lakeproof.sources.staging import written

DEEP_KEYS = "tokenizer.ggml.tokens,tokenizer.ggml.token_type"


def model_findings(models: DataFrame, meta: DataFrame, tensors: DataFrame, deep: bool = False, manifests: DataFrame | None = None, repo_files: DataFrame | None = None) -> DataFrame:
    """Findings of models given as tables, with severity and title; in no order."""
    values = metadata.current(meta).where((F.col("key") != fixed.TEMPLATE_KEY) & F.col("v_str").isNotNull()).select("model_id", "key", F.col("v_str").alias("value"))
    parts = [
        templates.template_findings(models, meta), metadata.value_findings(meta, tensors), templates.embedded_findings(values), metadata.consistency_findings(meta, tensors),
        tokenizer.tokenizer_findings(meta, tensors, deep), structure.structure_findings(models, meta, tensors),
    ]
    if manifests is not None:
        parts.append(integrity.manifest_findings(integrity.read_manifest(manifests), models, meta, tensors))
    if repo_files is not None:
        parts.append(bundle.bundle_findings(repo_files, meta))
    return with_registry(union(parts))


def audit(spark: SparkSession, path: str, deep: bool = False, repo_files: DataFrame | None = None, manifests: DataFrame | None = None) -> DataFrame:
    """Findings of all model files under ``path``, in their final order. Files that can't be parsed have none; see ``models.parse_error``.

    Every file is read once, when this is called; it is hashed only if there are manifests to hold it against.
    """
    options = {"materialize": DEEP_KEYS} if deep or repo_files is not None else {}
    if manifests is not None:
        options["sha256"] = "true"
    models, meta, tensors = gguf.load_once(spark, path, **options)
    return ordered(model_findings(models, meta, tensors, deep, manifests, repo_files))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, sha256, template_sha256, manifest)."""
    models, meta, tensors = gguf.load_once(spark, path, sha256="true")
    known = integrity.templates_of(meta).select("model_id", "template_sha256")
    return models.select("model_id", "sha256").join(known, "model_id", "left").join(integrity.manifest(models, meta, tensors), "model_id", "left")


def diff(spark: SparkSession, a: str, b: str) -> dict[str, DataFrame]:
    return integrity.compare(gguf.load_once(spark, a), gguf.load_once(spark, b))


# --- rendering; small, ordered results ---

# --- fixed values: verdicts ---
VERDICTS = {
    "FAIL": "POTENTIALLY DANGEROUS CONSTRUCTS DETECTED - manual review required. This flags risk indicators; it is not proof the model is malicious.",
    "REVIEW": "Risk indicators found - review recommended. These are heuristic flags, not proof of malicious behavior.",
    "PASS": "No risk indicators detected. This does not prove the model is safe - only that no known-dangerous construct was found by these rules.",
}


def render_json(file: str, sha256: str | None, template_sha256: str | None, findings: list) -> str:
    """One model's report: fields in a fixed order, ASCII, byte-identical for identical input. ``findings`` are rows in their final order."""
    listed = [{k: f[k] for k in ("rule_id", "severity", "title", "detail", "location")} for f in findings]
    counts = {s.lower(): sum(f["severity"] == s for f in findings) for s in SEVERITIES}
    return json.dumps({"file": file, "sha256": sha256, "template_sha256": template_sha256, "findings": listed, "summary": counts}, indent=2, ensure_ascii=True)


def render_text(file: str, sha256: str | None, template_sha256: str | None, findings: list) -> str:
    counts = {s: sum(f["severity"] == s for f in findings) for s in SEVERITIES}
    says = "FAIL" if counts["FAIL"] else "REVIEW" if counts["WARN"] else "PASS"
    lines = [f"scan: {file}", f"  sha256          {sha256 or '(not available)'}", f"  template_sha256 {template_sha256 or '(none)'}", "", VERDICTS[says], "  " + ", ".join(f"{counts[s]} {s.lower()}" for s in SEVERITIES)]
    for s in SEVERITIES:
        group = [f for f in findings if f["severity"] == s]
        if group:
            lines += ["", f"[{s}]"]
        for f in group:
            lines += [f"  {f['rule_id']} {f['title']}" + (f" ({f['location']})" if f["location"] else ""), f"      {f['detail']}"]
    return "\n".join([*lines, ""])


def write_corpus_report(spark: SparkSession, path: str, out: str, deep: bool = False, most_listed: int = 60) -> dict:
    """Audit all model files under ``path`` and write JSON under ``out``: results, skips and rule_histogram. Gives the summary and the first failing models by name."""
    models, meta, tensors = gguf.load_once(spark, path, **({"materialize": DEEP_KEYS} if deep else {}))
    found = written(model_findings(models, meta, tensors, deep), "findings")
    rows = written(gate.corpus_rows(models, meta, found), "corpus")
    skipped = models.where("parse_error is not null").select("model_id", F.col("parse_error").alias("error"))
    gate.rule_histogram(found).write.json(f"{out}/rule_histogram")
    rows.write.json(f"{out}/results")
    skipped.write.json(f"{out}/skips")
    failing = rows.where("n_fail > 0").orderBy("model_id").limit(most_listed)
    return {"summary": gate.corpus_summary(rows, skipped).first().asDict(), "fails": [r.asDict() for r in failing.select("model_id", "fails").collect()]}


def rule_list() -> list[dict]:
    return [dict(zip(("rule_id", "severity", "title", "description"), r)) for r in RULES]


def summary(findings: DataFrame, models: DataFrame) -> DataFrame:
    return severity_summary(findings, models.where("parse_error is null"))
