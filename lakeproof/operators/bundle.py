"""Rules over a repository's other files: decoding configuration, tokenizer files, templates, and the model card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.functions import fixed, text
from lakeproof.functions.json_facts import config_udf, settings_udf, surfaces_udf, tokenizer_udf
from lakeproof.operators.findings import hit, union
from lakeproof.operators.metadata import current
from lakeproof.operators.templates import embedded_findings, repo_template_findings
from lakeproof.operators.tokenizer import vocabulary
from lakeproof.sources.staging import written

PHASE = 60
_ROOT = "tokenizer.ggml."
#: Bytes beyond which a file isn't read.
MOST_BYTES = {"tokenizer.json": 48 << 20, "special_tokens_map.json": 4 << 20, "added_tokens.json": 4 << 20, "tokenizer_config.json": 4 << 20, "processor_config.json": 4 << 20}
MOST_OTHER = 1 << 20


def files(repo_files: DataFrame, *names: str) -> DataFrame:
    """Files of these names that aren't too long."""
    limit = F.lit(MOST_OTHER)
    for name, most in MOST_BYTES.items():
        limit = F.when(F.col("file_name") == name, most).otherwise(limit)
    return repo_files.where(F.col("file_name").isin(*names)).where((F.octet_length("text") <= limit) & (F.col("text") != ""))


def surfaces(metadata: DataFrame) -> DataFrame:
    """(model_id, surfaces): vocabularies that were read whole."""
    return vocabulary(metadata).where("not tokens.truncated and tokens.preview_str is not null").select("model_id", F.col("tokens.preview_str").alias("surfaces"))


def file_surfaces(repo_files: DataFrame) -> DataFrame:
    """(model_id, surfaces) from tokenizer.json, for repositories whose model file's vocabulary isn't at hand."""
    return files(repo_files, "tokenizer.json").select("model_id", surfaces_udf("text").alias("surfaces")).where("surfaces is not null")


def reconstructed(ids: Column, vocab: Column) -> Column:
    """The text of token ids: signs of a word's start as spaces, unknown ids left out."""

    def one(i: Column) -> Column:
        s = F.get(vocab, F.when((i >= 0) & (i < F.size(vocab)), i).cast("int"))
        return F.when(F.left(s, F.lit(1)).isin("▁", "Ġ"), F.concat(F.lit(" "), F.substring(s, 2, 1 << 30))).otherwise(s)

    return F.array_join(F.transform(ids, one), "")


def forced_groups(forced: DataFrame) -> DataFrame:
    """(model_id, file_name, place, grp, ids): forced (place, pos, id) put in order and cut wherever the next position isn't one more, or there is none."""
    by = Window.partitionBy("model_id", "file_name", "place").orderBy("pos", "id")
    step = F.when(F.col("pos") == F.lag("pos").over(by) + 1, 0).otherwise(1)
    numbered = forced.withColumn("new", step).withColumn("nth", F.row_number().over(by)).withColumn("grp", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("model_id", "file_name", "place", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("ids"))


def config_findings(repo_files: DataFrame, metadata: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """CFG001 to CFG005, and MET020 and MET021 on free texts; located ``file:...``.

    Files are parsed once, when this is called; what they declare is written and read again by each rule. ``vocab`` stands in for the models' own
    vocabularies, as :func:`file_surfaces` does.
    """
    c = files(repo_files, *fixed.BUNDLE_CONFIGS).select("model_id", "file_name", config_udf("text").alias("c")).where("c.ok").select("model_id", "file_name", "c.*").drop("ok")
    c = written(c, "configs")
    order = F.when(F.col("file_name") == fixed.BUNDLE_CONFIGS[0], 0).otherwise(1) * 1000
    at = lambda where: F.concat("file_name", F.lit(":"), where if isinstance(where, Column) else F.lit(where))

    def several(df: DataFrame, checks: list[tuple]) -> DataFrame:
        """Findings of a row's checks (rule, seq, condition, detail, place), in one pass."""
        each = F.array_compact(F.array(*[
            F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(seq).alias("n"), detail.alias("detail"), at(where).alias("location"))) for rule, seq, cond, detail, where in checks
        ]))
        return df.select("model_id", F.lit(PHASE).alias("phase"), order.alias("base"), F.explode(each).alias("x")).select("model_id", "phase", (F.col("base") + F.col("x.n")).cast("long").alias("seq"), "x.rule_id", "x.detail", "x.location")

    vocab = surfaces(metadata) if vocab is None else vocab
    keys = [_ROOT + k for k in fixed.STOP_IDS]
    stops = current(metadata.where(F.col("key").isin(*keys))).where("v_int is not null").groupBy("model_id").agg(F.collect_set(F.col("v_int").cast("bigint")).alias("own_stop"))
    bare = lambda i: F.lower(F.ltrim(F.get("surfaces", F.when((i >= 0) & (i < F.size("surfaces")), i).cast("int")), F.lit("▁Ġ ")))
    words = F.filter("suppressed", lambda i: F.coalesce(bare(i).isin(*fixed.REFUSAL_WORDS), F.lit(False)))
    phrases = F.filter(F.transform("banned", lambda seq: reconstructed(seq, F.col("surfaces"))), lambda s: s.rlike(fixed.REFUSAL_PATTERN))
    shown = F.when(F.col("surfaces").isNotNull(), F.concat(F.transform(words, lambda i: i.cast("string")), F.transform(phrases, lambda s: F.trim(s))))
    both = F.array_sort(F.array_intersect("suppressed", F.array_union("stop", F.coalesce("own_stop", F.array().cast("array<bigint>")))))
    decoding = several(c, [
        ("CFG004", 2, F.size("auto_map") > 0, F.concat(F.size("auto_map").cast("string"), F.lit(" classes: "), F.array_join(F.slice("auto_map", 1, 4), ", ")), "config.auto_map"),
        ("CFG005", 6, F.col("penalty") > fixed.MOST_REPETITION_PENALTY, F.concat(F.lit("repetition_penalty "), F.col("penalty").cast("string")), "generation_config.repetition_penalty"),
        ("CFG005", 7, F.col("ngram") == 1, F.lit("no token may come twice"), "generation_config.no_repeat_ngram_size"),
    ])
    some = c.where((F.size("suppressed") > 0) | (F.size("banned") > 0))
    settings = some.join(stops, "model_id", "left").join(vocab, "model_id", "left").withColumn("both", both).withColumn("shown", shown)
    kept_back = several(settings, [
        ("CFG001", 8, F.size("both") > 0, F.concat(F.lit("never ends by "), F.to_json("both")), "generation_config.suppress_tokens"),
        ("CFG002", 9, F.size("shown") > 0, F.concat(F.lit("keeps back "), F.array_join(F.slice("shown", 1, 6), ", ")), "generation_config"),
    ])
    free = c.select("model_id", "file_name", F.explode("strings").alias("s")).select("model_id", "file_name", "s.*").where(F.length("value") >= fixed.FREE_TEXT_LENGTH)
    looked = free.withColumn("hidden", text.code_points(F.col("value"), text.CONCEALED)).withColumn("idiom", text.first_instruction(text.lexical(F.col("value"))))
    texts = several(looked, [
        ("MET020", 0, F.col("hidden") != "", F.concat(F.lit("hides "), "hidden"), F.col("key")),
        ("MET021", 1, F.col("idiom").isNotNull(), F.concat(F.lit("says "), "idiom"), F.col("key")),
    ])
    return union([decoding, kept_back, texts, embedded_findings(free.select("model_id", F.concat("file_name", F.lit(":"), "key").alias("key"), "value")), forced_findings(c, vocab, order)])


def forced_findings(c: DataFrame, vocab: DataFrame, order: Column) -> DataFrame:
    """CFG003: the first group of consecutive forced tokens, and the first forced first and last token, whose text is an instruction."""
    none = F.lit(None).cast("bigint")
    entry = lambda where, pos, i: F.struct(F.lit(where).alias("place"), pos.alias("pos"), i.alias("id"))
    every = F.concat(F.transform("forced", lambda p: entry(0, p["pos"], p["id"])), F.transform("forced_bos", lambda i: entry(1, none, i)), F.transform("forced_eos", lambda i: entry(2, none, i)))
    ids = c.select("model_id", "file_name", F.explode(every).alias("e")).select("model_id", "file_name", "e.*").join(vocab.select("model_id"), "model_id", "left_semi")
    groups = forced_groups(ids).join(vocab, "model_id").withColumn("said", reconstructed(F.col("ids"), F.col("surfaces"))).drop("surfaces")
    groups = groups.withColumn("idiom", text.first_instruction(text.lexical(F.col("said")))).where("idiom is not null")
    first = F.row_number().over(Window.partitionBy("model_id", "file_name", "place").orderBy("grp"))
    where = F.element_at(F.array(F.lit("forced_decoder_ids"), F.lit("forced_bos_token_id"), F.lit("forced_eos_token_id")), F.col("place") + 1)
    return groups.withColumn("n_", first).where("n_ = 1").select(*hit("CFG003", PHASE, order + 3 + F.col("place"), F.concat(F.lit("forces "), "said"), F.concat("file_name", F.lit(":generation_config."), where)))


def tokenizer_file_findings(repo_files: DataFrame, metadata: DataFrame) -> DataFrame:
    """NRM001 to NRM003."""
    t = files(repo_files, "tokenizer.json").select("model_id", tokenizer_udf("text").alias("t")).where("t.ok").select("model_id", "t.*")
    letters = lambda s: s.rlike(r"\p{L}")
    stripped = F.regexp_replace(F.regexp_replace("pattern", r"\(\?[a-zA-Z]+\)", ""), r"\\[A-Za-z]", "")
    rewrites = t.select("model_id", F.posexplode("replaces").alias("i", "r")).select("model_id", "i", "r.*").where(letters(F.when(F.col("is_regex"), stripped).otherwise(F.col("pattern"))) | letters(F.col("content")))
    parts = [rewrites.select(*hit("NRM001", PHASE + 1, F.col("i"), F.concat(F.col("pattern"), F.lit(" becomes "), F.col("content")), F.concat(F.lit("tokenizer.json:"), "section")))]
    idiom = lambda s: text.first_instruction(text.lexical(s))
    added = t.select("model_id", F.posexplode("added").alias("i", "s"), "inserted").where(F.array_contains("inserted", F.col("s"))).withColumn("idiom", idiom(F.col("s"))).where("idiom is not null")
    parts.append(added.select(*hit("NRM003", PHASE + 2, F.col("i"), F.concat(F.lit("an inserted token says "), "idiom"), F.lit("tokenizer.json:added_tokens"))))

    s = files(repo_files, "special_tokens_map.json", "added_tokens.json", "tokenizer_config.json").select("model_id", "file_name", settings_udf("text").alias("s")).where("s.ok").select("model_id", "file_name", "s.*")
    config = s.where("file_name = 'tokenizer_config.json'").select("model_id", "add_bos", "add_eos", F.col("bos").alias("c_bos"), F.col("eos").alias("c_eos"))
    special = s.where("file_name = 'special_tokens_map.json'").select("model_id", F.col("bos").alias("s_bos"), F.col("eos").alias("s_eos"))
    ids = [f"{_ROOT}{x}" for x in ("add_bos_token", "add_eos_token", "bos_token_id", "eos_token_id")]
    now = current(metadata.where(F.col("key").isin(*ids))).groupBy("model_id").agg(*[F.max(F.when(F.col("key") == k, F.col("v_bool") if "add" in k else F.col("v_int"))).alias(k.split(".")[-1]) for k in ids])
    models = union([x.select("model_id") for x in (s, t, now)]).distinct()
    every = models.join(t.select("model_id", "inserted", "added"), "model_id", "left").join(config, "model_id", "left").join(special, "model_id", "left").join(now, "model_id", "left").join(surfaces(metadata), "model_id", "left")
    none = F.array().cast("array<string>")
    reach = F.coalesce("inserted", none)
    for token in ("bos", "eos"):
        on = F.coalesce(F.col(f"add_{token}") | F.lit(False), F.lit(False)) | F.coalesce(F.col(f"add_{token}_token"), F.lit(False))
        i = F.col(f"{token}_token_id")
        own = F.get("surfaces", F.when((i >= 0) & (i < F.size("surfaces")), i).cast("int"))
        reach = F.array_union(reach, F.when(on, F.array_compact(F.concat(F.coalesce(f"c_{token}", f"s_{token}", none), F.array(own)))).otherwise(none))
    reachable = every.select("model_id", F.array_except(reach, F.coalesce("added", none)).alias("reachable"))
    place = F.when(F.col("file_name") == "special_tokens_map.json", 0).otherwise(1)
    tokens = s.where("file_name <> 'tokenizer_config.json'").select("model_id", place.alias("place"), F.posexplode("strings").alias("i", "s")).where("s <> ''")
    seen = F.row_number().over(Window.partitionBy("model_id", "s").orderBy("place", "i"))
    tokens = tokens.withColumn("n_", seen).where("n_ = 1").withColumn("seq", F.col("place").cast("long") * (1 << 32) + F.col("i")).withColumn("hidden", text.code_points(F.col("s"), text.CONCEALED)).withColumn("idiom", idiom(F.col("s")))
    parts.append(tokens.where("hidden <> ''").select(*hit("NRM002", PHASE + 3, F.col("seq"), F.concat(F.lit("a token hides "), "hidden"), F.lit("special_tokens"))))
    said = tokens.where("idiom is not null").join(reachable, "model_id").where(F.array_contains("reachable", F.col("s")))
    parts.append(said.select(*hit("NRM003", PHASE + 4, F.col("seq"), F.concat(F.lit("an inserted token says "), "idiom"), F.lit("special_tokens"))))
    return union(parts)


def card_findings(cards: DataFrame, where: str = "README.md") -> DataFrame:
    """DOC001 and DOC002 over (model_id, text)."""
    c = cards.select("model_id", text.code_points(F.col("text"), text.CONCEALED).alias("hidden"), text.first_instruction(text.lexical(F.col("text"))).alias("idiom"))
    return c.where("hidden <> ''").select(*hit("DOC001", PHASE + 40, F.lit(0), F.concat(F.lit("hides "), "hidden"), F.lit(where))).unionByName(
        c.where("idiom is not null").select(*hit("DOC002", PHASE + 41, F.lit(0), F.concat(F.lit("says "), "idiom"), F.lit(where))))


def repo_templates(repo_files: DataFrame) -> DataFrame:
    """(model_id, ord, variant, source) of templates beside the model: tokenizer_config.json, chat_template.jinja, processor_config.json."""
    s = files(repo_files, "tokenizer_config.json", "processor_config.json").select("model_id", "file_name", settings_udf("text").alias("s")).where("s.ok")
    each = s.select("model_id", "file_name", F.posexplode("s.templates").alias("i", "t")).where("file_name = 'tokenizer_config.json' or t.place = ''")
    listed = each.select("model_id", (F.when(F.col("file_name") == "tokenizer_config.json", 0).otherwise(2_000_000) + F.col("i")).alias("ord"), F.concat("file_name", "t.place").alias("variant"), F.col("t.source").alias("source"))
    own = files(repo_files, "chat_template.jinja").where("trim(text) <> ''").select("model_id", F.lit(1_000_000).alias("ord"), F.col("file_name").alias("variant"), F.col("text").alias("source"))
    return listed.unionByName(own)


def bundle_findings(repo_files: DataFrame, metadata: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """All findings of the files beside a model: repo_files (model_id, file_name, text); ``vocab`` as in :func:`config_findings`."""
    return union([
        config_findings(repo_files, metadata, vocab), tokenizer_file_findings(repo_files, metadata),
        repo_template_findings(repo_templates(repo_files), metadata), card_findings(files(repo_files, "README.md")),
    ])
