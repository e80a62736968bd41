"""Metadata rules, and metadata held against the tensor map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeproof.functions import fixed, text
from lakeproof.operators.findings import hit, shuffled, union

PHASE = 20


def current(metadata: DataFrame) -> DataFrame:
    """One row per key: the last value, as loaders that overwrite see it."""
    last = Window.partitionBy("model_id", "key").orderBy(F.desc("ord"))
    return metadata.withColumn("last_", F.row_number().over(last)).where("last_ = 1").drop("last_")


def architecture(metadata: DataFrame) -> DataFrame:
    """(model_id, arch) of models whose last architecture is a text that isn't empty."""
    last = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("ord")))
    now = metadata.where("key = 'general.architecture'").withColumn("last_", last).where("last_ = 1").select("model_id", F.col("v_str").alias("arch"))
    return now.where("coalesce(arch, '') <> ''")


def as_int() -> Column:
    """An integer value; a boolean counts as 0 or 1."""
    return F.coalesce(F.col("v_int"), F.col("v_bool").cast("int").cast("decimal(20,0)"))


def declared(metadata: DataFrame, suffixes: list[str], keys: tuple[str, ...] = (), reals: tuple[str, ...] = ()) -> DataFrame:
    """One row per model that has some of these: model_id, arch (null if none), and as integers the last value of each ``<architecture>.<suffix>`` and of each whole key; suffixes in ``reals`` also give v_int and v_double.

    One shuffle of the wanted keys and one of the architectures; the aggregate goes by the join's own partitioning, and by hash, as it keeps nothing but numbers.
    """
    key = F.col("key")
    wanted = key.isin(*keys) if keys else F.lit(False)
    for suffix in suffixes:
        wanted = wanted | key.endswith("." + suffix)
    rows = metadata.where(wanted).select("model_id", "ord", "key", "v_int", "v_double", as_int().alias("n")).join(shuffled(architecture(metadata)), "model_id", "left")
    rows = rows.withColumn("own", F.when(key.startswith(F.concat("arch", F.lit("."))), F.expr("substring(key, length(arch) + 2)")))
    last = lambda value, by, k, name: F.max_by(value, F.when(F.col(by) == k, F.col("ord"))).alias(name)
    own = [last("n", "own", suffix, suffix) for suffix in suffixes] + [last(v, "own", suffix, f"{suffix}.{v}") for suffix in reals for v in ("v_int", "v_double")]
    return rows.groupBy("model_id", "arch").agg(*own, *[last("n", "key", k, k) for k in keys])


def scalar(metadata: DataFrame, suffix: str) -> DataFrame:
    """(model_id, arch, value) of the integer ``<architecture>.<suffix>``."""
    return declared(metadata, [suffix]).select("model_id", "arch", F.col(f"`{suffix}`").alias("value")).where("value is not null")


def shards(metadata: DataFrame) -> DataFrame:
    """model_id of files that are one of several parts."""
    return current(metadata.where("key = 'split.count'")).where(as_int() > 1).select("model_id")


def named(tensors: DataFrame, *names: str) -> DataFrame:
    """Tensors of these names; of several alike, the last."""
    last = Window.partitionBy("model_id", "name").orderBy(F.desc("ord"))
    return tensors.where(F.col("name").isin(*names)).withColumn("last_", F.row_number().over(last)).where("last_ = 1").drop("last_")


def last_named(tensors: DataFrame, name: str) -> DataFrame:
    """Tensors of this name, of several alike the last; one shuffle, by the model alone, which a join can go on with."""
    last = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("ord")))
    return tensors.where(F.col("name") == name).withColumn("last_", last).where("last_ = 1").drop("last_")


def duplicate_keys(metadata: DataFrame) -> DataFrame:
    """(model_id, key, seq) of keys that occur again, in the order in which they first do."""
    nth = Window.partitionBy("model_id", "key").orderBy("ord")
    return metadata.withColumn("nth", F.row_number().over(nth)).where("nth = 2").select("model_id", "key", F.col("ord").alias("seq"))


#: Layer numbers below 64 times this are bits of so many integers; larger ones are rows.
_WORDS = 4


def layer_gaps(tensors: DataFrame) -> DataFrame:
    """(model_id, top, missing): layer numbers absent below the highest, the first eight; models without gaps have no row.

    Usual numbers are bits, gathered by one hash aggregate; gaps among the others are found between neighbours. Nothing is counted up to the highest number, whatever a file claims.
    """
    digits = F.when(F.col("name").startswith("blk."), F.regexp_extract("name", "^blk[.]([0-9]+)[.]", 1))
    numbers = lambda kind: digits.try_cast(kind).alias("i")
    bits = lambda w: F.coalesce(F.bit_or(F.when(F.shiftright("i", 6) == w, F.expr("shiftleft(1L, cast(i & 63 as int))"))), F.lit(0).cast("bigint"))
    low = F.max(F.when(F.col("i") < 64 * _WORDS, F.col("i"))).alias("low")
    below = tensors.select("model_id", numbers("bigint")).groupBy("model_id").agg(low, *[bits(w).alias(f"bits{w}") for w in range(_WORDS)]).where("low is not null")

    large = tensors.where(F.col("name").rlike("^blk[.]0*[1-9][0-9]{2}[0-9]*[.]"))
    rest = large.select("model_id", numbers("decimal(38,0)")).distinct().where(F.col("i") >= 64 * _WORDS)
    by = Window.partitionBy("model_id").orderBy("i")
    gap = rest.withColumn("from", F.coalesce(F.lag("i").over(by), F.lit(64 * _WORDS - 1)) + 1).withColumn("top", F.max("i").over(Window.partitionBy("model_id")))
    width = F.greatest(F.least(F.col("i") - F.col("from"), F.lit(8)), F.lit(0)).cast("int")
    holes = gap.withColumn("width", width).withColumn("nth", F.row_number().over(Window.partitionBy("model_id").orderBy(F.col("width") == 0, "i"))).where("nth <= 8")
    each = holes.select("model_id", "top", F.transform(F.slice(F.sequence(F.lit(0), "width"), F.lit(1), F.col("width")), lambda k: (F.col("from") + k).cast("decimal(38,0)")).alias("found"))
    above = each.groupBy("model_id", "top").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))

    both = below.join(shuffled(above), "model_id", "full")
    end = F.when(F.col("top").isNotNull(), 64 * _WORDS).otherwise(F.col("low"))
    held = sum((F.bit_count(F.coalesce(f"bits{w}", F.lit(0))) for w in range(_WORDS)), F.lit(0)) - F.when(F.col("top").isNull(), 1).otherwise(0)
    words = F.array(*[F.coalesce(f"bits{w}", F.lit(0)) for w in range(_WORDS)])
    absent = F.filter(F.sequence(F.lit(0), F.greatest(end, F.lit(1)).cast("int") - 1), lambda i: F.getbit(F.get(words, F.shiftright(i, 6)), F.pmod(i, F.lit(64))) == 0)
    known = F.when(held < end, F.transform(absent, lambda i: i.cast("decimal(38,0)")))
    missing = F.slice(F.concat(F.coalesce(known, F.expr("cast(array() as array<decimal(38,0)>)")), F.coalesce("found", F.expr("cast(array() as array<decimal(38,0)>)"))), 1, 8)
    return both.select("model_id", F.coalesce("top", F.col("low").cast("decimal(38,0)")).alias("top"), missing.alias("missing")).where(F.size("missing") > 0)


def dominant_dtype(tensors: DataFrame) -> DataFrame:
    """(model_id, dtype): the commonest among plain weights, the first seen of equals."""
    plain = tensors.where(F.col("name").endswith(".weight") & ~F.col("name").contains("norm") & ~F.col("name").isin("token_embd.weight", "output.weight"))
    counts = plain.groupBy("model_id", "dtype").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("n"), "first", "dtype"))
    return counts.withColumn("best", best).where("best = 1").select("model_id", "dtype")


def feed_forward(tensors: DataFrame) -> DataFrame:
    """(model_id, ffn_shape, ffn_name): the first feed-forward matrix."""
    parts, name = F.split("name", "[.]"), F.col("name")
    ffn = tensors.where(name.contains("ffn_") & (F.size("shape") == 2) & F.get(parts, F.size(parts) - 2).isin("ffn_up", "ffn_gate", "ffn_down"))
    nth = F.row_number().over(Window.partitionBy("model_id").orderBy("ord"))
    return ffn.withColumn("nth", nth).where("nth = 1").select("model_id", F.col("shape").alias("ffn_shape"), F.col("name").alias("ffn_name"))


_SIZES = ["block_count", "embedding_length", "attention.head_count", "attention.head_count_kv", "attention.key_length", "feed_forward_length", "context_length", "rope.scaling.original_context_length", "rope.freq_base"]


def checked(df: DataFrame, checks: tuple, holds: int) -> tuple[DataFrame, Callable[[Callable], Column]]:
    """A row for each check that holds, and what chooses a value by it: only numbers of checks are made for every row."""
    rows = df.withColumn("check", F.explode(F.array_compact(F.array(*[F.when(check[holds], F.lit(i)) for i, check in enumerate(checks)]))))
    return rows, lambda value: F.coalesce(*[F.when(F.col("check") == i, value(check)) for i, check in enumerate(checks)])


def consistency_findings(metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """MET010 to MET016: a row of declared values per model meets what its tensors say, and all rules but the last are conditions on that row.

    Only the numbers of the rules that hold are made for every model; texts are made after, for findings alone.
    """
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    twice = duplicate_keys(metadata).select(*hit("MET016", PHASE + 4, F.col("seq"), say("key ", F.col("key"), " is defined more than once"), F.col("key")))

    table = last_named(tensors, "token_embd.weight").select("model_id", F.col("shape").alias("table_shape"))
    models = declared(metadata, _SIZES, ("general.file_type", "split.count"), ("rope.freq_base",))
    for facts in (layer_gaps(tensors), table, feed_forward(tensors), dominant_dtype(tensors)):
        models = models.join(shuffled(facts), "model_id", "left")
    number = lambda name: F.col(f"`{name}`")
    codes = F.create_map(*[F.lit(x) for code, dtype in fixed.FILE_TYPE_DTYPES.items() for x in (code, dtype)])
    models = models.withColumn("expected", F.try_element_at(codes, F.expr("try_cast(`general.file_type` as int)")))

    at = lambda suffix: F.concat("arch", F.lit("." + suffix))
    whole = ~F.coalesce(number("split.count") > 1, F.lit(False))
    some = lambda suffix: F.when(number(suffix) != 0, number(suffix))
    embedding, heads, kv, forward = number("embedding_length"), some("attention.head_count"), some("attention.head_count_kv"), number("feed_forward_length")
    context, original = number("context_length"), number("rope.scaling.original_context_length")
    gaps = F.array_join(F.transform("missing", lambda m: m.cast("string")), ", ")
    checks = (
        ("MET010", 5, 0, whole & number("block_count").isNotNull() & F.col("missing").isNotNull(), say("layers ", gaps, " are missing below ", F.col("top")), at("block_count")),
        ("MET011", 6, 0, whole & ~F.array_contains("table_shape", embedding), say("embedding_length ", embedding, " is no axis of ", F.to_json("table_shape")), at("embedding_length")),
        ("MET012", 7, 0, number("attention.key_length").isNull() & (F.try_mod(embedding, heads) != 0), say("embedding_length ", embedding, " is no multiple of head_count ", heads), at("attention.head_count")),
        ("MET012", 7, 1, F.try_mod(heads, kv) != 0, say("head_count ", heads, " is no multiple of head_count_kv ", kv), at("attention.head_count_kv")),
        ("MET013", 8, 0, whole & ~F.array_contains("ffn_shape", forward), say("feed_forward_length ", forward, " is no axis of ", F.col("ffn_name")), at("feed_forward_length")),
        ("MET014", 9, 0, whole & F.col("arch").isNotNull() & (F.col("dtype") != F.col("expected")), say("declared ", F.col("expected"), ", most weights are ", F.col("dtype")), F.lit("general.file_type")),
        ("MET015", 10, 0, context < original, say("context_length ", context, " is below the original ", original), at("context_length")),
        ("MET015", 10, 1, F.coalesce(number("rope.freq_base.v_int") <= 0, F.lit(False)) | F.coalesce(number("rope.freq_base.v_double") <= 0, F.lit(False)), F.lit("rope.freq_base is not positive"), at("rope.freq_base")),
    )
    rows, one = checked(models, checks, 3)
    found = hit("", 0, one(lambda c: F.lit(c[2])), one(lambda c: c[4]), one(lambda c: c[5]))
    found[1:4] = [one(lambda c: F.lit(PHASE + c[1])).alias("phase"), found[2], one(lambda c: F.lit(c[0])).alias("rule_id")]
    return union([twice, rows.select(*found)])


def string_findings(metadata: DataFrame) -> DataFrame:
    """MET001 to MET004, MET020 and MET021 of the values that are texts, and MET003 of all keys.

    What is found in a text is told where the text is read, each text once; only that, and no text, goes through the shuffles by which the current values are known.
    """
    key, v = F.col("key"), F.col("v_str")
    provenance = F.lit(False)
    for term in fixed.PROVENANCE_TERMS:
        provenance = provenance | F.lower(key).contains(term)
    found = F.concat(text.urls(v), text.addresses(v))
    address = (text.has(v, fixed.URL_PATTERN) & ~provenance) | text.has(v, fixed.IP_PATTERN)
    preview = F.when(F.length(v) <= 120, v).otherwise(F.concat(F.substring(v, 1, 117), F.lit("...")))
    facts = metadata.where(key != fixed.TEMPLATE_KEY).select(
        "model_id", "ord", "key", F.length(v).alias("n_chars"), preview.alias("preview"), address.alias("has_address"), F.when(address, F.get(found, F.lit(0))).alias("address"),
        text.has(v, text.CONCEALED).alias("hides"), text.code_points(v, text.CONCEALED).alias("hidden"), text.first_instruction(text.lexical(v)).alias("lex"))
    now = current(facts).join(shuffled(architecture(metadata)), "model_id", "left")
    now = now.withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy("key")) * 10)
    plain = F.lit(False)
    for p in fixed.KNOWN_PREFIXES:
        plain = plain | key.startswith(p)
    plain = plain | F.coalesce(key.startswith(F.concat("arch", F.lit("."))), F.lit(False))
    long = F.col("n_chars") > fixed.LONG_STRING
    checks = (
        ("MET003", 0, ~plain, F.concat(F.lit("key "), key, F.lit(" is in no known namespace"))), ("MET001", 1, F.col("has_address"), F.concat(F.lit("value holds "), F.col("address"))),
        ("MET002", 2, long, F.concat(F.col("n_chars").cast("string"), F.lit(" characters"))), ("MET004", 2, ~long, F.concat(key, F.lit(" = "), F.col("preview"))),
        ("MET020", 3, F.col("hides"), F.concat(F.lit("value hides "), F.col("hidden"))), ("MET021", 4, F.col("lex").isNotNull(), F.concat(F.lit("value says "), F.col("lex"))),
    )
    rows, one = checked(now, checks, 2)
    found = hit("", PHASE, F.col("n") + one(lambda c: F.lit(c[1])), one(lambda c: c[3]), key)
    found[3] = one(lambda c: F.lit(c[0])).alias("rule_id")
    return rows.select(*found)


def value_findings(metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """MET001 to MET006, MET020 and MET021, over current values in key order, without the template itself."""
    return union([string_findings(metadata), element_findings(metadata), model_findings(metadata, tensors)])


def element_findings(metadata: DataFrame) -> DataFrame:
    """MET001 and MET021 of the elements of current values that are arrays of texts."""
    now = current(metadata).where(F.col("key") != fixed.TEMPLATE_KEY)
    now = now.withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy("key")) * 10)
    key = F.col("key")
    lists = now.where("arr.elem_type = 'string'").select("model_id", "key", "n", F.posexplode("arr.preview_str").alias("at", "item"))
    one = Window.partitionBy("model_id", "key").orderBy("at")
    item = F.col("item")
    first = lambda df: df.withColumn("nth_", F.row_number().over(one)).where("nth_ = 1")
    with_address = first(lists.where(text.has(item, fixed.URL_PATTERN) | text.has(item, fixed.IP_PATTERN)))
    said = lists.where((F.length(item) >= 16) & (key != "tokenizer.ggml.merges")).withColumn("lex", text.first_instruction(text.lexical(item))).where("lex is not null")
    return union([
        with_address.select(*hit("MET001", PHASE, F.col("n") + 5, F.concat(F.lit("an element holds an address: "), item), key)),
        first(said).select(*hit("MET021", PHASE, F.col("n") + 6, F.concat(F.lit("an element says "), F.col("lex")), key)),
    ])


def model_findings(metadata: DataFrame, tensors: DataFrame) -> DataFrame:
    """MET005 and MET006: architectures without a key of their own, and types that nobody knows."""
    key = F.col("key")
    arch = architecture(metadata).join(shuffled(tensors.select("model_id").distinct()), "model_id", "left_semi")
    own = metadata.join(shuffled(arch), "model_id").where(key.startswith(F.concat("arch", F.lit(".")))).select("model_id").distinct()
    bare = arch.join(shuffled(own), "model_id", "left_anti").select(*hit("MET005", PHASE + 1, F.lit(0), F.concat(F.lit("no key of "), F.col("arch")), F.lit("general.architecture")))
    strange = tensors.where(F.col("dtype").startswith("GGML_TYPE_")).withColumn("nth", F.row_number().over(Window.partitionBy("model_id", "dtype").orderBy("ord"))).where("nth = 1")
    return union([bare, strange.select(*hit("MET006", PHASE + 2, F.col("ord"), F.concat(F.lit("tensor "), F.col("name"), F.lit(" is of "), F.col("dtype")), F.col("name")))])
