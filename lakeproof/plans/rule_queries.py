"""More of the audit's rules as queries over the driver's tables: each goes through the library's own rule functions, and the SQL gives the same findings.

Orders stand in for models with their lines as tensors, events for configuration files, parts for tokenizer files, customers for manifests. Values are drawn from whole tables, so
that each rule fires on some rows and not on others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.functions import fixed
from lakeproof.operators import bundle, findings, integrity, metadata, structure, templates, tokenizer
from lakeproof.plans import gate, release
from lakeproof.plans.queries import _FIRST_SQL, _IP_SQL, _LEX_SQL, _NO_ARRAY, _NO_TENSORS, _TENSORS_SQL, _URL_SQL, _added_sql, _models, _vocabulary, added, query, table

_ARRAY = "struct<elem_type: string, length: decimal(20,0), preview_str: array<string>, preview_int: array<decimal(20,0)>, truncated: boolean, max_elem_bytes: bigint>"


def _entry(ord_: int, key: str | Column, text_: Column | None = None, number: Column | None = None, flag: Column | None = None, array: Column | None = None) -> Column:
    """One metadata row as a struct; a null value leaves the key out."""
    kind = "string" if text_ is not None else "int" if number is not None else "bool" if flag is not None else "array"
    none = F.lit(None)
    return F.struct(
        F.lit(ord_).alias("ord"), (F.lit(key) if isinstance(key, str) else key).alias("key"), F.lit(kind).alias("vtype"), (none if text_ is None else text_).cast("string").alias("v_str"), (none if number is None else number).cast("decimal(20,0)").alias("v_int"),
        none.cast("double").alias("v_double"), (none if flag is None else flag).cast("boolean").alias("v_bool"), (F.expr(_NO_ARRAY) if array is None else array.cast(_ARRAY)).alias("arr"),
    )


def _metadata(df: DataFrame, model_id: Column, entries: list[Column]) -> DataFrame:
    each = df.select(model_id.alias("model_id"), F.explode(F.array(*entries)).alias("e")).select("model_id", "e.*")
    return each.where("v_str is not null or v_int is not null or v_bool is not null or arr is not null")


def _arr(kind: str, length: Column, strings: Column | None = None, ints: Column | None = None, longest: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("elem_type"), length.cast("decimal(20,0)").alias("length"), (F.lit(None) if strings is None else strings).cast("array<string>").alias("preview_str"), (F.lit(None) if ints is None else ints).cast("array<decimal(20,0)>").alias("preview_int"), F.lit(False).alias("truncated"), (F.lit(8) if longest is None else longest).cast("bigint").alias("max_elem_bytes"))


# --- tensors of impossible size ---


@query("WITH " + _TENSORS_SQL.replace("(l_quantity * 16)::BIGINT AS d0, l_suppkey % 5 AS d1", "(l_quantity * 1073741824)::BIGINT::HUGEINT AS d0, (l_suppkey % 7)::HUGEINT * 268435456 AS d1, (l_partkey % 4)::HUGEINT AS d2")
    .replace("(d0 * type_size) // block_size * d1", "(d0 * type_size) // block_size * d1 * d2") + """
SELECT model_id, ord FROM sized WHERE d0 * d1 * d2 > 9223372036854775807 OR n_bytes > 9223372036854775807""")  # fmt: skip
def oversized_tensors(spark, sf_dir):
    """Tensors whose elements or bytes don't fit signed 64 bits (STR001)."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    shape = [(F.col("l_quantity") * (1 << 30)).cast("decimal(20,0)"), (s % 7).cast("decimal(20,0)") * (1 << 28), (p % 4).cast("decimal(20,0)")]
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("ord"), F.lit("t").alias("name"), F.array(*[d.cast("decimal(20,0)") for d in shape]).alias("shape"), F.lit("x").alias("dtype"), (p % 40).alias("type_id"), F.lit(0).cast("decimal(20,0)").alias("offset"))
    found = structure.tensor_findings(structure.placed(_models(spark, sf_dir), t)).where("rule_id = 'STR001'")
    return found.select("model_id", (F.col("seq") / 8).cast("int").alias("ord"))


# --- metadata held against the tensor map ---

_MAP_SQL = """WITH t AS (SELECT l_orderkey AS model_id, l_linenumber AS ord, CASE l_linenumber WHEN 1 THEN 'token_embd.weight' WHEN 2 THEN 'blk.0.ffn_up.weight' WHEN 3 THEN 'blk.0.ffn_down.weight' WHEN 4 THEN 'blk.1.attn_norm.weight' ELSE 'blk.' || l_linenumber || '.attn.weight' END AS name,
  (l_orderkey * 7 + l_linenumber) % 9 AS a, (l_orderkey * 3 + l_linenumber) % 9 AS b, CASE (l_orderkey + l_linenumber * l_linenumber) % 5 WHEN 0 THEN 'Q4_0' WHEN 1 THEN 'F16' WHEN 2 THEN 'GGML_TYPE_77' WHEN 3 THEN 'F32' ELSE 'GGML_TYPE_78' END AS dtype FROM lineitem),
m AS (SELECT o_orderkey AS model_id, CASE WHEN o_orderkey % 7 = 0 THEN 'bare' ELSE 'toy' END AS arch, o_custkey % 9 AS emb, (o_orderkey // 4) % 9 AS ffn, o_custkey % 10 AS code, o_orderkey % 11 = 0 AS part FROM orders),
d AS (SELECT model_id, dtype FROM (SELECT model_id, dtype, count(*) AS n, min(ord) AS first FROM t WHERE ord <> 1 AND ord <> 4 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY n DESC, first, dtype) = 1),
f AS (SELECT * FROM t WHERE ord IN (2, 3) QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY ord) = 1),
c AS (SELECT * FROM (VALUES (0, 'F32'), (1, 'F16'), (2, 'Q4_0'), (3, 'Q4_1'), (7, 'Q8_0'), (8, 'Q5_0'), (9, 'Q5_1')) AS c(code, expected))
"""


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")  # lines of one number are alike, as some orders repeat one
    name = F.when(n == 1, "token_embd.weight").when(n == 2, "blk.0.ffn_up.weight").when(n == 3, "blk.0.ffn_down.weight").when(n == 4, "blk.1.attn_norm.weight").otherwise(F.concat(F.lit("blk."), n.cast("string"), F.lit(".attn.weight")))
    dtype = F.element_at(F.array(*[F.lit(d) for d in ("Q4_0", "F16", "GGML_TYPE_77", "F32", "GGML_TYPE_78")]), ((o + n * n) % 5 + 1).cast("int"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model_id"), n.alias("ord"), name.alias("name"), F.array(((o * 7 + n) % 9).cast("decimal(20,0)"), ((o * 3 + n) % 9).cast("decimal(20,0)")).alias("shape"), dtype.alias("dtype"), F.lit(0).cast("bigint").alias("type_id"), F.lit(0).cast("decimal(20,0)").alias("offset"))
    o = F.col("o_orderkey")
    meta = _metadata(table(spark, sf_dir, "orders"), o, [
        _entry(0, "general.architecture", F.when(o % 7 == 0, "bare").otherwise("toy")), _entry(1, "toy.embedding_length", number=F.col("o_custkey") % 9), _entry(2, "toy.feed_forward_length", number=F.floor(o / 4) % 9),
        _entry(3, "general.file_type", number=F.col("o_custkey") % 10), _entry(4, "split.count", number=F.when(o % 11 == 0, 2)),
    ])
    return meta, t


@query(_MAP_SQL + """SELECT DISTINCT model_id, 'MET011' AS rule_id, 'toy.embedding_length' AS location FROM m JOIN t USING (model_id) WHERE arch = 'toy' AND NOT part AND ord = 1 AND emb <> a AND emb <> b
UNION ALL SELECT model_id, 'MET013', 'toy.feed_forward_length' FROM m JOIN f USING (model_id) WHERE arch = 'toy' AND NOT part AND ffn <> a AND ffn <> b
UNION ALL SELECT model_id, 'MET014', 'general.file_type' FROM m JOIN c USING (code) JOIN d USING (model_id) WHERE NOT part AND dtype <> expected""")
def declared_against_tensors(spark, sf_dir):
    """Declared sizes that no axis has, and a file type that most weights aren't of (MET011, MET013, MET014)."""
    found = metadata.consistency_findings(*_mapped(spark, sf_dir))
    return found.where("rule_id in ('MET011', 'MET013', 'MET014')").select("model_id", "rule_id", "location")


@query(_MAP_SQL + """SELECT DISTINCT model_id, 'MET005' AS rule_id, 'general.architecture' AS location FROM m JOIN t USING (model_id) WHERE arch = 'bare'
UNION ALL SELECT model_id, 'MET006', name FROM (SELECT * FROM t WHERE dtype LIKE 'GGML%' QUALIFY row_number() OVER (PARTITION BY model_id, dtype ORDER BY ord) = 1)""")
def strange_models(spark, sf_dir):
    """Architectures without a key of their own, and types that nobody knows (MET005, MET006)."""
    return metadata.model_findings(*_mapped(spark, sf_dir)).select("model_id", "rule_id", "location")


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'tokenizer.ggml.merges' ELSE 'general.tags' END AS key, {_added_sql('text', 'doc_id')} AS s0 FROM documents),
i AS (SELECT doc_id, key, unnest(string_split(s0, chr(10))) AS s FROM t), l AS (SELECT *, {_LEX_SQL} AS lex FROM i)
SELECT DISTINCT doc_id, 'MET001' AS rule_id, key AS location FROM l WHERE regexp_matches(s, '{_URL_SQL}') OR regexp_matches(s, '{_IP_SQL}')
UNION ALL SELECT DISTINCT doc_id, 'MET021', key FROM l WHERE length(s) >= 16 AND key = 'general.tags' AND {_FIRST_SQL} IS NOT NULL""")
def array_values(spark, sf_dir):
    """Addresses and instructions in the elements of string arrays (MET001, MET021), each document's lines an array."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(added(F.col("text"), n), "\n", -1).alias("lines"))
    key = F.when(n % 4 == 0, "tokenizer.ggml.merges").otherwise("general.tags")
    found = metadata.value_findings(_metadata(docs, n, [_entry(0, key, array=_arr("string", F.size("lines"), F.col("lines")))]), spark.createDataFrame([], _NO_TENSORS))
    return found.where("rule_id in ('MET001', 'MET021')").select(F.col("model_id").alias("doc_id"), "rule_id", "location")


# --- tokenizers ---


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey % 30 AS vocab, o_orderkey % 9000 AS longest, o_custkey % 30 + (o_orderkey % 3 = 0)::INT AS scores, o_custkey % 30 + (o_orderkey % 5 = 0)::INT AS kinds, o_orderkey % 9 AS kind, o_orderkey % 31 AS rows, o_orderkey % 13 = 0 AS part FROM orders)
SELECT id AS model_id, 'TOK002' AS rule_id, 'tokenizer.ggml.tokens' AS location FROM m WHERE NOT part AND vocab > greatest(rows, 16)
UNION ALL SELECT id, 'TOK003', 'tokenizer.ggml.scores' FROM m WHERE scores <> vocab UNION ALL SELECT id, 'TOK003', 'tokenizer.ggml.token_type' FROM m WHERE kinds <> vocab
UNION ALL SELECT id, 'TOK003', 'tokenizer.ggml.token_type' FROM m WHERE kind NOT BETWEEN 1 AND 6 UNION ALL SELECT id, 'TOK004', 'tokenizer.ggml.tokens' FROM m WHERE longest > 4096""")
def tokenizer_arrays(spark, sf_dir):
    """Vocabularies larger than their matrix, side arrays of other lengths or kinds, and huge tokens (TOK002 to TOK004)."""
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 30
    orders = table(spark, sf_dir, "orders")
    bump = lambda k: c + F.when(o % k == 0, 1).otherwise(0)
    meta = _metadata(orders, o, [
        _entry(0, "tokenizer.ggml.tokens", array=_arr("string", c, longest=o % 9000)), _entry(1, "tokenizer.ggml.scores", array=_arr("float32", bump(3))), _entry(2, "tokenizer.ggml.token_type", array=_arr("int32", bump(5), ints=F.array(F.lit(1), o % 9))),
        _entry(3, "split.count", number=F.when(o % 13 == 0, 4)),
    ])
    t = orders.select(o.alias("model_id"), F.lit(0).alias("ord"), F.lit("output.weight").alias("name"), F.array(F.lit(16).cast("decimal(20,0)"), (o % 31).cast("decimal(20,0)")).alias("shape"), F.lit("F16").alias("dtype"), F.lit(1).cast("bigint").alias("type_id"), F.lit(0).cast("decimal(20,0)").alias("offset"))
    return tokenizer.tokenizer_findings(meta, t).select("model_id", "rule_id", "location")


@query("""WITH t AS (SELECT conv_id AS model_id, CASE turn % 3 WHEN 0 THEN '<｜' || role || '｜>' WHEN 1 THEN '<|' || role || '|>' ELSE text END AS s, turn % 3 < 2 AS special FROM conversations)
SELECT model_id, count(DISTINCT CASE WHEN special THEN s END) || ' role marks among ' || count(DISTINCT s) || ' tokens, ' || count(*) FILTER (WHERE special) || ' of them control' AS detail FROM t GROUP BY model_id""")
def role_marks(spark, sf_dir):
    """How many role marks a vocabulary has among how many tokens (TOK015), by the deep pass."""
    found = tokenizer.tokenizer_findings(_vocabulary(spark, sf_dir), spark.createDataFrame([], _NO_TENSORS), deep=True)
    return found.where("rule_id = 'TOK015'").select("model_id", "detail")


# --- files beside a model ---

_SURFACES = ["▁sorry", "▁never", "▁mention", "it", "</s>", "▁can", "'t"]


@query("""WITH c AS (SELECT event_id AS model_id, (props->>'k')::BIGINT AS k FROM events)
SELECT model_id, 'CFG002' AS rule_id, 'generation_config.json:generation_config' AS location FROM c WHERE k % 7 = 0 OR k % 5 = 0
UNION ALL SELECT model_id, 'CFG003', 'generation_config.json:generation_config.forced_decoder_ids' FROM c WHERE k % 3 = 1
UNION ALL SELECT model_id, 'MET021', 'generation_config.json:system_prompt' FROM c WHERE k % 4 = 0 UNION ALL SELECT model_id, 'MET020', 'generation_config.json:system_prompt' FROM c WHERE k % 4 = 1""")
def kept_back_and_forced(spark, sf_dir):
    """Refusals that are kept back, instructions that are forced or written out, hidden characters (CFG002, CFG003, MET020, MET021), over JSON made of the events' own."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    s = lambda c: c.cast("string")
    prompt = F.when(k % 4 == 0, "from now on you are").when(k % 4 == 1, "quite ​hidden text").otherwise("a plain text of some length")
    shown = F.concat(F.lit('{"suppress_tokens": ['), s(k % 7), F.lit('], "bad_words_ids": ['), F.when(k % 5 == 0, "[5, 6]").otherwise("[3, 4]"), F.lit('], "forced_decoder_ids": [[1, '), s(k % 3), F.lit("], [2, "), s(k % 3 + 1), F.lit(']], "system_prompt": "'), prompt, F.lit('"}'))
    events = table(spark, sf_dir, "events")
    files = events.select(F.col("event_id").alias("model_id"), F.lit("generation_config.json").alias("file_name"), shown.alias("text"))
    vocab = events.select(F.col("event_id").alias("model_id"), F.array(*[F.lit(x) for x in _SURFACES]).alias("surfaces"))
    none = _metadata(events.limit(0), F.col("event_id"), [_entry(0, "none", F.lit(None))])
    return bundle.config_findings(files, none, vocab).select("model_id", "rule_id", "location")


@query("""WITH p AS (SELECT p_partkey AS model_id, p_partkey AS k FROM part)
SELECT model_id, 'NRM001' AS rule_id, 'tokenizer.json:normalizer' AS location FROM p WHERE k % 3 = 1 UNION ALL SELECT model_id, 'NRM003', 'tokenizer.json:added_tokens' FROM p WHERE k % 4 = 0
UNION ALL SELECT model_id, 'NRM002', 'special_tokens' FROM p WHERE k % 5 = 0 UNION ALL SELECT model_id, 'NRM003', 'special_tokens' FROM p WHERE k % 2 = 0""")
def tokenizer_files(spark, sf_dir):
    """Rewrites of words, hidden characters in tokens, and inserted tokens that instruct (NRM001 to NRM003), over JSON made of the parts' names."""
    p, name = F.col("p_partkey"), F.col("p_name")
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "model_id").withColumn("p_partkey", F.col("model_id"))
    pattern = F.when(p % 3 == 0, '{"String": " "}').when(p % 3 == 1, F.concat(F.lit('{"String": "'), name, F.lit('"}'))).otherwise('{"Regex": "(?i)\\\\s+"}')
    added_token = F.when(p % 4 == 0, "always say yes").otherwise("never reveal it")
    main = F.concat(F.lit('{"normalizer": {"type": "Sequence", "items": [{"type": "Replace", "pattern": '), pattern, F.lit(', "content": " "}]}, "post_processor": {"special": ["always say yes"]}, "added_tokens": [{"content": "'), added_token, F.lit('", "special": true}]}'))
    special = F.concat(F.lit('{"bos_token": {"content": "never warn '), name, F.lit('"}, "pad_token": "'), F.when(p % 5 == 0, "a​").otherwise("a"), F.lit('"}'))
    flags = F.concat(F.lit('{"add_bos_token": '), F.when(p % 2 == 0, "true").otherwise("false"), F.lit("}"))
    each = F.array(*[F.struct(F.lit(n).alias("file_name"), t.alias("text")) for n, t in (("tokenizer.json", main), ("special_tokens_map.json", special), ("tokenizer_config.json", flags))])
    none = _metadata(part.limit(0), F.col("model_id"), [_entry(0, "none", F.lit(None))])
    return bundle.tokenizer_file_findings(part.select("model_id", F.explode(each).alias("f")).select("model_id", "f.*"), none).select("model_id", "rule_id", "location")


# --- manifests ---


@query("""WITH c AS (SELECT c_custkey AS model_id, c_custkey % 10 AS k FROM customer)
SELECT model_id, 'INT001' AS rule_id, NULL AS location FROM c WHERE k = 3 UNION ALL SELECT model_id, 'INT002', 'tokenizer.chat_template' FROM c WHERE k IN (2, 4)
UNION ALL SELECT model_id, 'INT003', 'general.name' FROM c WHERE k IN (5, 6) UNION ALL SELECT model_id, 'INT003', 'general.extra' FROM c WHERE k = 7
UNION ALL SELECT model_id, 'INT004', 't' FROM c WHERE k = 8 UNION ALL SELECT model_id, 'INT004', 'u' FROM c WHERE k = 9""")
def manifest_findings(spark, sf_dir):
    """Files, templates, metadata and tensors that aren't as a manifest says (INT001 to INT004): manifests are built by the library and read back, then a tenth of the customers changes each thing."""
    c = table(spark, sf_dir, "customer")
    k, i, name = F.col("c_custkey") % 10, F.col("c_custkey"), F.col("c_name")
    dec = lambda x: F.lit(x).cast("decimal(20,0)")

    def tables(new: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        on = lambda *which: k.isin(*which) & F.lit(new)
        models = c.select(i.alias("model_id"), F.sha2(F.when(on(3), F.concat(name, F.lit("x"))).otherwise(name), 256).alias("sha256"))
        meta = _metadata(c, i, [
            _entry(0, "tokenizer.chat_template", F.when(on(2), F.lit(None)).when(on(4), F.concat(name, F.lit(" "), name)).otherwise(F.concat(name, F.lit("\r\n")))), _entry(1, "general.name", F.when(on(5), F.concat(name, F.lit("!"))).when(~on(6), name)),
            _entry(2, "general.extra", number=F.when(on(7), 1)), _entry(3, "general.tags", array=_arr("string", F.lit(2), F.array(name, name))),
        ])
        one = lambda n, there, size: F.when(there, F.struct(F.lit(n).alias("name"), F.array(dec(4), size).alias("shape")))
        listed = F.array_compact(F.array(one("t", F.lit(True), F.when(on(8), dec(3)).otherwise(dec(2))), one("u", ~on(9), dec(2))))
        tensors = c.select(i.alias("model_id"), F.posexplode(listed).alias("ord", "t")).select("model_id", "ord", "t.*", F.lit("F16").alias("dtype"), F.lit(1).cast("bigint").alias("type_id"), dec(0).alias("offset"))
        return models, meta, tensors

    return integrity.manifest_findings(integrity.read_manifest(integrity.manifest(*tables(False))), *tables(True)).select("model_id", "rule_id", "location")


# --- templates and the corpus ---


@query("SELECT o_orderkey AS model_id FROM orders WHERE o_orderkey % 3 <> 1")
def missing_templates(spark, sf_dir):
    """Models that were read and have no template (TPL101); other values and other models' templates don't count."""
    o = F.col("o_orderkey")
    key = F.when(o % 3 == 0, "tokenizer.chat").when(o % 2 == 0, fixed.TEMPLATE_KEY).otherwise(fixed.TEMPLATE_KEY + ".rag")
    meta = _metadata(table(spark, sf_dir, "orders").where(o % 3 != 2), o, [_entry(0, key, F.lit("{{ x }}"))])
    return templates.without_template(_models(spark, sf_dir), meta).select("model_id")


_CORPUS_SQL = """WITH m AS (SELECT o_orderkey AS id, o_custkey % 17 AS arch, o_orderkey % 3 = 0 AS tpl, o_orderkey % 5 = 0 AS bad, o_orderkey % 7 = 0 AS flag, o_orderkey % 4 = 0 AS warned FROM orders WHERE o_orderkey % 10 <> 9)
"""


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    models = orders.select(o.alias("model_id"), F.when(o % 10 == 9, "broken").alias("parse_error"))
    meta = _metadata(orders, o, [_entry(0, "general.architecture", F.when(F.col("o_custkey") % 17 > 0, (F.col("o_custkey") % 17).cast("string"))), _entry(1, fixed.TEMPLATE_KEY, F.when(o % 3 == 0, "{{ x }}"))])
    rules = F.array_compact(F.array(F.when(o % 5 == 0, "TPL001"), F.when(o % 5 == 0, "TPL001"), F.when(o % 7 == 0, "TPL023"), F.when(o % 4 == 0, "MET001")))
    raw = orders.where(o % 10 != 9).select(o.alias("model_id"), F.posexplode(rules).alias("seq", "rule_id")).select("model_id", F.lit(0).alias("phase"), "seq", "rule_id", F.lit("").alias("detail"), F.lit("").alias("location"))
    return gate.corpus_rows(models, meta, findings.with_registry(raw)), models.where("parse_error is not null")


@query(_CORPUS_SQL + """SELECT id AS model_id, CASE WHEN arch > 0 THEN arch::VARCHAR END AS arch, tpl AS has_template, CASE WHEN bad THEN 2 ELSE 0 END::BIGINT AS n_fail, (flag::INT + warned::INT)::BIGINT AS n_warn,
  concat_ws(',', CASE WHEN warned THEN 'MET001' END, CASE WHEN bad THEN 'TPL001' END, CASE WHEN flag THEN 'TPL023' END) AS rules FROM m""")
def corpus_rows(spark, sf_dir):
    """A corpus report's row for each model that was read."""
    return _corpus(spark, sf_dir)[0].select("model_id", "arch", "has_template", "n_fail", "n_warn", F.array_join("rules", ",").alias("rules"))


@query(_CORPUS_SQL + """SELECT count(*) AS n_scanned, count(*) FILTER (WHERE tpl) AS n_with_template, count(*) FILTER (WHERE bad) AS n_with_fail, count(*) FILTER (WHERE flag) AS n_behavioural,
  round_even(100.0 * count(*) FILTER (WHERE flag) / greatest(count(*) FILTER (WHERE tpl), 1), 3)::DOUBLE AS behavioural_pct, count(DISTINCT CASE WHEN arch > 0 THEN arch END) AS n_architectures, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 9) AS n_skipped FROM m""")
def corpus_summary(spark, sf_dir):
    """A corpus report's counters, distinct architectures among them."""
    return gate.corpus_summary(*_corpus(spark, sf_dir))


@query("""SELECT c_name || '/' || c_custkey AS repo, array_to_string(list_sort(['README.md', 'config.json'][1:c_custkey % 3]), ',') AS bundle_files, array_to_string(list_sort(['z-' || c_custkey || '.GGUF', 'a.gguf'][1:c_custkey % 4]), ',') AS gguf_files,
  CASE WHEN c_custkey % 2 = 0 THEN '{{ ' || c_custkey || ' }}' END AS chat_template FROM customer""")
def catalogue_inventory(spark, sf_dir):
    """The inventory of saved catalogue pages, one for each nation."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("key", k.cast("string"))
    some = lambda n, *names: F.slice(F.array(*names), F.lit(1), (k % n).cast("int"))
    files = F.concat(some(3, F.lit("README.md"), F.lit("config.json")), some(4, F.concat(F.lit("z-"), "key", F.lit(".GGUF")), F.lit("a.gguf"), F.lit("b-mmproj.gguf")), F.array(F.lit("x.bin")))
    model = F.struct(F.concat("c_name", F.lit("/"), "key").alias("id"), F.transform(files, lambda f: F.struct(f.alias("rfilename"))).alias("siblings"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("{{ "), "key", F.lit(" }}"))).alias("chat_template")).alias("gguf"))
    nation = F.col("c_nationkey").cast("string")
    pages = c.groupBy(nation.alias("url")).agg(F.to_json(F.collect_list(model)).alias("body")).withColumn("next_url", F.concat("url", F.lit("+")))
    flat = gate.inventory_of(pages)
    return flat.select("repo", F.array_join("bundle_files", ",").alias("bundle_files"), F.array_join("gguf_files", ",").alias("gguf_files"), "chat_template")


# --- the release gate ---

_RELEASE_SQL = """WITH c AS (SELECT 'o/r' || c_custkey AS repo, c_custkey AS k FROM customer),
s AS (SELECT *, k % 2 = 0 AND k % 11 <> 0 AS gen, k % 3 = 0 AND k % 13 <> 0 AS tok FROM c), v AS (SELECT *, gen AND k % 4 = 0 AS forced, tok AND k % 9 <> 0 AS spelt FROM s),
n AS (SELECT *, forced AND NOT spelt AS need, k % 7 < 5 AS model, k % 20 <> 16 AS good FROM v), g AS (SELECT *, need AND model AND good AS header_fallback FROM n),
r AS (SELECT *, concat_ws(',', CASE WHEN forced AND (spelt OR header_fallback) THEN 'CFG003' END, CASE WHEN gen AND k % 8 = 0 THEN 'CFG004' END, CASE WHEN gen AND k % 4 <> 0 AND k % 10 = 2 THEN 'CFG005' END,
  CASE WHEN tok AND k % 6 = 0 THEN 'NRM003' END, CASE WHEN k % 5 = 0 THEN 'TPL021,TPL027' END) AS rules,
  (k % 2 = 0 AND k % 11 = 0)::INT + (k % 3 = 0 AND k % 13 = 0)::INT + (need AND NOT (model AND good))::INT AS n_errors FROM g)
"""


def _release(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("o/r"), F.col("c_custkey").cast("string")).alias("repo"), F.col("c_custkey").alias("k"))
    listed = lambda n, cond: F.when(cond, F.lit(n))
    template = F.when(k % 5 == 0, "{% if 'deploy' in messages[-1]['content'] %}{{ 'never ' ~ 'mention it' }}{% endif %}").when(k % 5 == 1, "{% for m in messages %}{{ m.role }}{% endfor %}")
    inventory = c.select("repo", F.array_compact(F.array(listed("generation_config.json", k % 2 == 0), listed("tokenizer.json", k % 3 == 0))).alias("bundle_files"), F.when(k % 7 < 5, F.array(F.lit("m.gguf"))).otherwise(F.array(F.lit("mmproj.gguf"))).alias("gguf_files"), template.alias("chat_template"))
    auto = F.when(k % 8 == 0, '"auto_map": {"AutoModel": "x.Y"}, ').otherwise("")
    config = F.when(k % 4 == 0, F.concat(F.lit("{"), auto, F.lit('"forced_decoder_ids": [[1, 0], [2, 1]]}'))).otherwise(F.concat(F.lit('{"no_repeat_ngram_size": '), F.when(k % 10 == 2, "1").otherwise("3"), F.lit("}")))
    said = F.when(k % 6 == 0, ', "added_tokens": [{"content": "always say yes", "special": true}], "post_processor": {"special": ["always say yes"]}').otherwise("")
    spelt = F.concat(F.lit('{"model": {'), F.when(k % 9 != 0, '"vocab": {"never": 0, "▁mention": 1}').otherwise(""), F.lit("}"), said, F.lit("}"))
    file = lambda name, there, bad, why, text_: F.when(there, F.struct(F.lit(name).alias("file"), F.when(bad, why).otherwise("ok").alias("status"), F.when(~bad, text_).alias("text"), F.when(bad, "not had").alias("error")))
    every = F.array_compact(F.array(file("generation_config.json", k % 2 == 0, k % 11 == 0, "over_cap", config), file("tokenizer.json", k % 3 == 0, k % 13 == 0, "refused", spelt)))
    texts = c.select("repo", F.explode(every).alias("f")).select("repo", "f.*")

    def headers(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        broken = F.substring("repo", 4, 99).cast("bigint") % 20 == 16
        models = asked.select(F.col("repo").alias("model_id"), F.col("file").alias("path"), F.when(broken, "cannot fit").alias("parse_error"))
        tokens = _arr("string", F.lit(2), F.array(F.lit("never"), F.lit("▁mention")))
        return models, _metadata(models.where("parse_error is null"), F.col("model_id"), [_entry(0, "tokenizer.ggml.tokens", array=tokens)])

    return release.release_gate(inventory, texts, headers)


@query(_RELEASE_SQL + "SELECT repo, rules, n_errors, header_fallback FROM r")
def release_gate_results(spark, sf_dir):
    """The two-step release gate over repositories made of the customers: headers are asked for where tokens are forced and no file spells them."""
    return _release(spark, sf_dir).select("repo", F.array_join(F.array_sort("hits.rule_id"), ",").alias("rules"), F.size("errors").alias("n_errors"), "header_fallback")


@query(_RELEASE_SQL + """SELECT count(*) AS n_repos, count(*) FILTER (WHERE n_errors = 0) AS n_successful, count(*) FILTER (WHERE n_errors > 0) AS n_with_errors, count(*) FILTER (WHERE header_fallback) AS n_header_fallbacks,
  sum(CASE WHEN rules = '' THEN 0 ELSE len(string_split(rules, ',')) END)::BIGINT AS n_hits, count(*) FILTER (WHERE rules <> '') AS n_flagged FROM r""")
def release_gate_statistics(spark, sf_dir):
    """The release gate's counters, header fallbacks and repositories with errors among them."""
    return release.release_statistics(_release(spark, sf_dir))
