"""The thirteen operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.llm._common import table


def op1_segment_statistics_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), details=True).drop("text", "lang", "n_chars")


def op3_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_rans_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.token_output import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))


def op5_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.url_filter import judge_urls, stand_in_list

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, stand_in_list(pages))


def op7_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op8_heavy_hitter_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.packing import pack_sequences

    return pack_sequences(table(spark, sf_dir, "documents"))


def op10_site_spread_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.line_dedup import remove_boilerplate

    return remove_boilerplate(table(spark, sf_dir, "documents"))


def op11_escaped_marker_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.fill_middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(F.encode(text, "utf-8"), 256)
    lengths = [F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars")]
    return out.select("doc_id", "n", "form", *lengths, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_golay_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.golay_dedup import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_lattice_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeproof.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_OP6 = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN md5(host) < '4' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP8 = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM keyed WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

_OP10 = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
bare AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM lines),
gone AS (SELECT key FROM bare WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce('s' || source, '')) >= 10),
told AS (SELECT doc_id, pos, line, key IN (SELECT key FROM gone) AS gone_ FROM bare)
SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE gone_))::INTEGER AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone_), '') AS text
FROM told GROUP BY doc_id
"""


_OP11 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
hashed AS (
  SELECT *, len(units) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parted AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""

_OP13 = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
masks AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask FROM words),
told AS (
  SELECT part, mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM masks LEFT JOIN labels USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS done FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
grouped AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS t FROM told GROUP BY part, mask),
walked AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (done | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & done = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & done <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(g) FILTER (WHERE mask & bit <> 0 AND mask & done = 0), 0) AS good_lost, coalesce(sum(t) FILTER (WHERE mask & bit <> 0 AND mask & done = 0), 0) AS toxic_lost
  FROM grouped, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM walked
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_bloom_cascade_url_filter": _OP6, "op8_heavy_hitter_exact_dedup": _OP8, "op10_site_spread_line_dedup": _OP10, "op11_escaped_marker_fill_in_middle": _OP11, "op13_lattice_filter_audit": _OP13}
