"""Template rules: text rules on the source, and filters over the facts of the parsed tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lakeproof.functions import fixed, text
from lakeproof.functions.template_scan import FACTS, scan
from lakeproof.operators.findings import deduplicated, hit, union
from lakeproof.operators.metadata import current

PHASE = 10
#: Rules that are told for the first node alone.
ONCE = ["TPL031", "TPL032"]
#: Facts that a task of the parser hands on at a time.
MOST_ROWS = 20_000


def templates(metadata: DataFrame) -> DataFrame:
    """(model_id, variant, source) of every template a file carries."""
    now = current(metadata.where((F.col("key") == fixed.TEMPLATE_KEY) | F.col("key").startswith(fixed.TEMPLATE_KEY + "."))).where("v_str is not null")
    variant = F.when(F.col("key") == fixed.TEMPLATE_KEY, "default").otherwise(F.substring("key", len(fixed.TEMPLATE_KEY) + 2, 1 << 30))
    return now.select("model_id", variant.alias("variant"), F.col("v_str").alias("source"))


def known_templates(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.KNOWN_TEMPLATES.items()), "sha256 string, known_name string")


def nodes(sources: DataFrame) -> DataFrame:
    """(model_id, variant, error, error_line, facts...): parse each template once, many tasks at a time."""
    ddl = f"model_id string, variant string, error string, error_line int, {FACTS}".replace("\n", " ")
    shape = to_arrow_schema(sources.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("model_id", "variant", "source"))):
                of = dict(zip(("model_id", "variant"), place))
                found, error = scan(place[2])
                if error:
                    rows.append(of | {"error": error[0], "error_line": error[1]})
                rows += [of | f for f in found]
                if len(rows) > MOST_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, shape)

    return sources.select("model_id", "variant", "source").mapInArrow(run, ddl)


def tree_findings(facts: DataFrame, embedded: bool = False) -> DataFrame:
    """Rules over the facts, in one pass, so that templates are parsed once; ``embedded`` leaves out parse failures and depth, for templates found in other values."""
    f = facts.withColumn("loc", F.when(F.col("line") > 0, F.concat(F.lit("template:L"), "line")).otherwise("template"))
    name, kind, context = F.col("name"), F.col("kind"), F.col("context")
    # a name's rules look at the key of map(attribute=...) where there is one
    named = F.coalesce(name, F.when(context == "subscript key", F.col("recon")))
    key = F.when(context == "map attribute", F.col("const_str")).otherwise(F.when(context.isin("attribute", "subscript key", "name"), named))
    said = F.when(kind == "Const", text.first_of(F.lower("const_str"), fixed.STRING_DUNDERS))
    token = text.first_of(F.lower("recon"), fixed.ASSEMBLED_TOKENS)
    lexical = F.col("lexical")
    f = f.withColumn("lexical", text.lexical(F.col("emitted")))
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in p])
    sensitive = F.filter("compared", lambda c: F.lower(c).isin(*fixed.SENSITIVE_LITERALS))
    place = F.when(F.col("error_line") > 0, F.concat(F.lit("template:L"), "error_line")).when(F.col("error_line") < 0, "template").when(F.col("error").startswith("parse"), "template")
    read = F.col("error").isNull()
    checks = [  # rule, phase, condition, detail, and where other than at the node
        ("TPL001", 0, key.isin(*fixed.DUNDERS), say("names ", key, " (", context, ")")),
        ("TPL003", 0, key.isin(*fixed.DANGEROUS_NAMES) | (key.isin(*fixed.DANGEROUS_MODULES) & (context != "attribute")), say("refers to ", key, " (", context, ")")),
        ("TPL002", 0, kind.isin("Getattr", "Getitem") & F.col("root").isin(*fixed.GADGETS) & named.isin(*fixed.GADGET_KEYS), say(F.col("root"), " leads to ", named)),
        ("TPL001", 0, (kind == "Getattr") & (name == "__class__") & F.col("of_literal"), say("takes __class__ of a literal")),
        ("TPL005", 0, token.isNotNull(), say("assembles ", token, ": ", F.col("recon"))),
        ("TPL001", 0, F.col("of_pivot"), say("subscripts a literal")),
        ("TPL001", 0, said.isNotNull(), say("a text holds ", said)),
        ("TPL004", 0, (kind == "Filter") & (name == "attr"), say("uses the attr filter")),
        ("TPL004", 0, F.col("attr_arg"), say("maps by attr")),
        ("TPL001", 0, (context == "map attribute") & (F.col("const_str") == "__class__"), say("maps by __class__")),
        ("TPL010", 0, F.size(sensitive) > 0, say("compares with ", F.array_join(sensitive, ", "))),
        ("TPL021", 2, F.col("injected").isNotNull(), say("adds instructions for certain content, by ", F.col("injected"))),
        ("TPL022", 2, F.col("dated"), say("a branch compares the date")),
        ("TPL027", 2, text.first_instruction(lexical).isNotNull(), say("assembles ", F.col("emitted"))),
        ("TPL031", 3, kind.isin("Include", "Import", "FromImport", "Extends"), say("uses ", F.lower(kind))),
        ("TPL032", 3, kind.isin("Filter", "Name") & name.isin(*fixed.DECODERS), say("decodes by ", name)),
    ]
    if not embedded:
        checks.append(("TPL013", 1, (kind == "Depth") & (F.col("depth") > fixed.MOST_DEPTH), say(F.col("depth"), " levels"), F.lit("template")))
    found = [F.when(read & F.coalesce(cond, F.lit(False)), _found(i, rule, phase, detail, *(where or [F.col("loc")]))) for i, (rule, phase, cond, detail, *where) in enumerate(checks)]
    if not embedded:
        found.append(F.when(~read, _found(len(checks), "TPL000", 0, F.col("error"), place)))
    rows = f.select("model_id", "variant", "visit", F.explode(F.array_compact(F.array(*found))).alias("x"))
    rows = rows.select("model_id", "variant", F.col("x.phase").alias("phase"), (F.coalesce("visit", F.lit(0)) * 32 + F.col("x.i")).alias("seq"), "x.rule_id", "x.detail", "x.location")
    nth = F.row_number().over(Window.partitionBy("model_id", "variant", "rule_id").orderBy("seq"))
    return rows.withColumn("nth_", nth).where(~F.col("rule_id").isin(*ONCE) | (F.col("nth_") == 1)).drop("nth_")


def _found(i: int, rule: str, phase: int, detail: Column, where: Column) -> Column:
    return F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule_id"), F.lit(PHASE + phase).alias("phase"), detail.cast("string").alias("detail"), where.cast("string").alias("location"))


def text_findings(sources: DataFrame) -> DataFrame:
    """TPL011, TPL012 and TPL023 to TPL026, on the source as it is."""
    s = F.col("source")
    idiom = text.first_instruction(text.lexical(s))
    found = F.concat(text.urls(s), text.addresses(s))
    checks = [
        ("TPL011", text.has(s, fixed.URL_PATTERN) | text.has(s, fixed.IP_PATTERN), F.concat(F.lit("holds "), F.get(found, F.lit(0)))),
        ("TPL012", F.octet_length(s) > fixed.MOST_TEMPLATE_BYTES, F.concat(F.length(s).cast("string"), F.lit(" characters"))),
        ("TPL025", text.has(s, text.BIDI), F.concat(F.lit("reorders by "), text.code_points(s, text.BIDI))),
        ("TPL024", text.has(s, text.HIDDEN), F.concat(F.lit("hides "), text.code_points(s, text.HIDDEN))),
        ("TPL026", text.has(s, text.CONTROL), F.concat(F.lit("holds "), text.code_points(s, text.CONTROL))),
        ("TPL023", F.col("idiom").isNotNull(), F.concat(F.lit("says "), F.col("idiom"))),
    ]
    each = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule_id"), detail.alias("detail"))) for i, (rule, cond, detail) in enumerate(checks)]))
    rows = sources.withColumn("idiom", idiom).select("model_id", "variant", F.explode(each).alias("x"))
    return rows.select("model_id", "variant", F.lit(PHASE + 4).alias("phase"), F.col("x.i").cast("long").alias("seq"), "x.rule_id", "x.detail", F.lit("template:text").alias("location"))


def template_findings(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """All TPL rules for each template of each model; vetted ones give TPL100 alone, models without any TPL101."""
    return tagged(source_findings(templates(metadata)), templates(metadata)).unionByName(without_template(models, metadata))


def without_template(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """TPL101 for models that were read and carry none."""
    some = templates(metadata).select("model_id").distinct()
    return models.where("parse_error is null").select("model_id").join(some, "model_id", "left_anti").select(*hit("TPL101", PHASE, F.lit(0), F.lit("no template key"), F.lit(None)))


def vetted(sources: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(TPL100 findings, the sources that aren't vetted); ``known`` (sha256, known_name; small) stands in for the built-in list."""
    known = F.broadcast(known_templates(sources.sparkSession) if known is None else known)
    hashed = sources.withColumn("sha256", text.template_sha256(F.col("source")))
    told = hashed.join(known, "sha256").select(*hit("TPL100", PHASE, F.lit(0), F.concat(F.lit("is "), F.col("known_name")), F.concat(F.lit("template_sha256="), F.col("sha256"))), "variant")
    return told, hashed.join(known, "sha256", "left_anti").select("model_id", "variant", "source")


def source_findings(sources: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Raw findings with a variant column, each model's variants deduplicated."""
    told, rest = vetted(sources, known)
    found = deduplicated(union([tree_findings(nodes(rest)), text_findings(rest)]), "variant")
    return told.unionByName(found)


def tagged(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Locations name the variant where a model has several; findings then follow the variants' order."""
    order = F.dense_rank().over(Window.partitionBy("model_id").orderBy("variant", "source"))
    ranked = sources.select("model_id", "variant", order.alias("place"), F.count("*").over(Window.partitionBy("model_id")).alias("n"))
    out = found.join(ranked, ["model_id", "variant"])
    tag = F.concat(F.lit("chat_template["), "variant", F.lit("]"))
    location = F.when(F.col("n") > 1, F.concat_ws(" ", tag, "location")).otherwise(F.col("location"))
    return out.select("model_id", "phase", (F.col("place") * (1 << 40) + F.col("seq")).alias("seq"), "rule_id", "detail", location.alias("location"))


def embedded_findings(values: DataFrame) -> DataFrame:
    """Findings of templates inside other values (model_id, key, value), where they parse; located ``key:...``."""
    some = values.where(F.col("value").contains("{%") | F.col("value").contains("{{")).select("model_id", F.col("key").alias("variant"), F.col("value").alias("source"))
    found = tree_findings(nodes(some), embedded=True)
    return found.select("model_id", F.lit(PHASE + 14).alias("phase"), "seq", "rule_id", "detail", F.concat("variant", F.lit(":"), F.coalesce("location", F.lit(""))).alias("location"))


def diverging(repo: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(TPL030 findings, repository templates that are none of the model's own) of (model_id, ord, variant: where from, source).

    Of templates that differ in white space only, the first counts; models without a template of their own have no TPL030.
    """
    own = templates(metadata).where("trim(source) <> ''").select("model_id", text.blank_key(F.col("source")).alias("k")).distinct()
    first = Window.partitionBy("model_id", "k").orderBy("ord")
    new = repo.withColumn("k", text.blank_key(F.col("source"))).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    other = new.join(own, ["model_id", "k"], "left_anti").select("model_id", "ord", "variant", "source")
    unlike = other.join(own.select("model_id").distinct(), "model_id", "left_semi").select(*hit("TPL030", PHASE + 20, F.col("ord"), F.concat(F.lit("template of "), F.col("variant"), F.lit(" is another")), F.col("variant")))
    return unlike, other


def repo_template_findings(repo: DataFrame, metadata: DataFrame) -> DataFrame:
    """TPL030 for repository templates unlike all of the model's own, and what those hold."""
    unlike, other = diverging(repo, metadata)
    inside = source_findings(other).select("model_id", (F.col("phase") + 21).alias("phase"), "seq", "rule_id", "detail", F.concat_ws(":", "variant", "location").alias("location"))
    return unlike.unionByName(inside)
