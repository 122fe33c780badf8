"""Queries of the text, number, log and migration functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import numbers as N
from cuemill.functions import text as X
from cuemill.operators import migrate, publish
from cuemill.operators.timed_text import sentences

from .tables import Registry, table, wrapped_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add(
    """SELECT p_partkey, CASE WHEN n IS NULL THEN '-' WHEN n >= 1000000000 THEN replace(printf('%.1fB', n / 1e9), '.0B', 'B') WHEN n >= 1000000 THEN replace(printf('%.1fM', n / 1e6), '.0M', 'M') WHEN n >= 1000 THEN replace(printf('%.1fK', n / 1e3), '.0K', 'K') ELSE CAST(n AS VARCHAR) END AS views,
CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration
FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * p_partkey * 997 // (1 + p_partkey % 7 * 1000) END AS n, CAST(p_size AS BIGINT) * p_size * 7 AS s FROM part)"""
)
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    views = F.when(k % 10 != 0, F.expr("p_partkey * p_partkey * 997 div (1 + p_partkey % 7 * 1000)"))
    return table(spark, sf_dir, "part").select("p_partkey", N.count_label(views).alias("views"), N.duration_label(F.col("p_size").cast("long") * F.col("p_size") * 7).alias("duration"))


@R.add("""SELECT doc_id, CASE WHEN w <= 24 THEN 24 WHEN w <= 48 THEN 48 WHEN w <= 96 THEN 96 WHEN w <= 160 THEN 160 ELSE 256 END AS budget FROM (SELECT doc_id, greatest(16, (n_chars // 40) * 3 + 8) AS w FROM documents)""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.token_budget(F.floor(F.col("n_chars") / 40)).alias("budget"))


@R.add("SELECT source, string_agg(lang || '=' || n, ', ' ORDER BY lang) AS summary FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("source", "lang").count()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lang", "count"))), lambda x: F.concat(x["lang"], F.lit("="), x["count"].cast("string")))
    return counted.groupBy("source").agg(F.array_join(parts, ", ").alias("summary"))


@R.add("SELECT source, count(*) AS labels, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, count(*) >= 2 AND max(n) <= 0.8 * sum(n) AS varied FROM (SELECT source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS label, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("source", X.text_key(F.col("text")).alias("label")).count()
    return counted.groupBy("source").agg(F.count("*").alias("labels"), F.max("count").alias("most"), F.sum("count").alias("total"), ((F.count("*") >= 2) & (F.max("count") <= 0.8 * F.sum("count"))).alias("varied"))


@R.add(r"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_key FROM documents""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.text_key(F.col("text")), 256).alias("text_key"))


@R.add(
    r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)\b(authorization|cookie|password|passwd|secret|token|api[_-]?key)\b(\s*[:=]\s*)([^\s,;]+)', '\1\2<redacted>', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?i)https?://[^\s"''<>]+', '<url>', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}([^\p{L}\p{N}_.-]|$)', '<email>\1', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '(?i)(?:[A-Z]:\\|\\\\)[^\r\n"''<>|]*', '<path>', 'g') AS t FROM c)
SELECT doc_id, sha256(regexp_replace(t, '(?i)(^|[^\p{L}\p{N}_.-])/(?:home|users)/[^/\s]+(?:/[^\s"''<>]*)?', '\1<path>', 'g')) AS redacted FROM d"""
)
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("redacted"))


@R.add("SELECT event_id, line FROM (SELECT event_id, event_type || ' ' || event_id AS line, row_number() OVER (ORDER BY event_id DESC) AS n, sum(length(event_type || ' ' || event_id) + 1) OVER (ORDER BY event_id DESC) AS size FROM events) WHERE n <= 800 AND size - 1 <= 6000")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    return publish.log_tail(lines, "event_id", "line", most_characters=6000)


@R.add("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, sum(length(event_type) + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS size FROM events) WHERE n <= 20 AND size - 1 <= 100")
def log_tail_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.log_tail(table(spark, sf_dir, "events"), "event_id", "event_type", by="user_id", most_lines=20, most_characters=100).select("user_id", "event_id")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey").cast("string")
    tags = F.concat(F.lit("#A"), F.col("o_orderstatus"), F.lit(", #a"), F.col("o_orderstatus"), F.lit(";x-"), i, F.lit("  ##_tag_ "), F.lit("#A"), F.lower("o_orderstatus"))
    caption = F.concat(F.lit("  Order \t"), i, F.lit(" \r\n\n  "), F.repeat(F.lit("wide 😀 text "), F.when(F.col("o_orderkey") % 25 == 0, F.col("o_orderkey") % 300).otherwise(F.col("o_orderkey") % 9).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tags.alias("tags"), caption.alias("caption"))


@R.add("SELECT o_orderkey, '#A' || o_orderstatus || ' #x' || o_orderkey || ' #tag' AS tags FROM orders")
def hashtag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("o_orderkey", F.array_join(X.hashtag_list(F.col("tags")), " ").alias("tags"))


@R.add(
    """WITH o AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 25 = 0 THEN o_orderkey % 300 ELSE o_orderkey % 9 END AS r, 'Order ' || o_orderkey AS base, '#A' || o_orderstatus || ' #x' || o_orderkey || ' #tag' AS tags FROM orders),
u AS (SELECT *, 2200 - 1 - length(tags) AS room, 2200 - 1 - length(tags) - length(base) - 1 AS left_over FROM o),
c AS (SELECT *, CASE WHEN r = 0 THEN base WHEN length(base) + 13 * r <= room THEN base || chr(10) || rtrim(repeat('wide 😀 text ', r))
  ELSE base || chr(10) || rtrim(repeat('wide 😀 text ', left_over // 13) || left('wide 😀 text ', CASE WHEN left_over % 13 <= 5 THEN left_over % 13 WHEN left_over % 13 = 6 THEN 5 ELSE left_over % 13 - 1 END)) END || chr(10) || tags AS post FROM u)
SELECT o_orderkey, post, CAST(2 * length(post) - length(replace(post, '😀', '')) AS INTEGER) AS units FROM c"""
)
def compose_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = publish.with_post_text(_tagged(spark, sf_dir).withColumnRenamed("tags", "hashtags"))
    return post.select("o_orderkey", F.col("post_text").alias("post"), X.utf16_length(F.col("post_text")).alias("units"))


@R.add(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 60 ELSE CAST(greatest(0, least(100, trunc(l_quantity * 3 - 20))) AS INTEGER) END AS original_video_volume, CAST(greatest(10, least(120, trunc(l_extendedprice / 300))) AS INTEGER) AS font_size, 8 AS schema_version,
CASE WHEN l_linenumber = 5 THEN 'failed' ELSE l_linestatus END AS status FROM lineitem WHERE l_linenumber <> 6"""
)
def clamp_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as metadata of older versions; volumes and sizes out of bounds, some unreadable, some of a newer version."""
    n = F.col("l_linenumber")
    fields = F.struct(
        F.when(n == 6, 9).when(n == 5, 2).otherwise(F.lit(5)).alias("schema_version"), F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("video_id"), F.when(n == 5, "error").otherwise(F.col("l_linestatus")).alias("status"),
        F.when(n == 7, "loud").otherwise((F.col("l_quantity") * 3 - 20).cast("string")).alias("original_video_volume"), F.struct((F.col("l_extendedprice") / 300).alias("font_size")).alias("subtitle_style"),
    )
    rows = table(spark, sf_dir, "lineitem").select(F.to_json(fields).alias("raw"))
    kept, _ = migrate.migrate_videos(rows)
    key = F.split("video_id", "-")
    return kept.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "original_video_volume", F.col("subtitle_style.font_size").alias("font_size"), "schema_version", "status")


@R.add(
    """WITH d AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'ok' ELSE text END AS out, CASE WHEN doc_id % 3 = 0 THEN 'Russian' ELSE 'French' END AS target, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n FROM documents),
m AS (SELECT *, length(regexp_replace(out, '[^\\p{L}\\p{N}]', '', 'g')) AS m FROM d)
SELECT doc_id, CASE WHEN n > 0 AND m = 0 THEN true WHEN n >= 35 AND m < greatest(6, n // 10) THEN true WHEN n >= 12 THEN target = 'Russian' AND NOT regexp_matches(out, '[Ѐ-ӿ]') ELSE false END AS suspicious FROM m""".replace("\\\\p", "\\p")
)
def script_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    out = F.when(i % 4 == 0, "").when(i % 4 == 1, "ok").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_suspicious_translation(F.col("text"), out, F.when(i % 3 == 0, "Russian").otherwise("French")).alias("suspicious"))


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@R.add(f"""SELECT conv_id, turn, {wrapped_sql("list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')", 32)} AS lines FROM conversations""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.wrap_lines(F.col("text"), 32).alias("lines"))


@R.add(
    r"""WITH a AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([…。！？][.!?…。！？"''”’)\]}」』]*)', '\1' || chr(1), 'g') AS t FROM conversations),
b AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(t, '([.!?][.!?…。！？"''”’)\]}」』]*) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM a)
SELECT conv_id, turn, CAST(k - 1 AS INTEGER) AS pos, s[k] AS sentence FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS k FROM b)"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


@R.add(
    r"""WITH a AS (SELECT conv_id, turn, translate(replace(coalesce(text, ''), chr(8230), '...'), chr(160) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212), ' ' || chr(39) || chr(39) || chr(34) || chr(34) || ',,') AS t FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(t, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') AS t FROM a)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[^.!?,;:]$') THEN t || '.' ELSE t END AS spoken FROM b"""
)
def speech_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.speech_text(F.col("text")).alias("spoken"))


@R.add(
    """SELECT o_orderkey, CASE WHEN p = 0 THEN -100.0 ELSE round(20 * log10(p / 100), 6) END AS db, CAST(greatest(1, ceil(o_totalprice / 700)) AS INTEGER) AS loops, least(300.0, 2.0 * pow(2.0, o_orderkey % 12)) AS backoff
FROM (SELECT o_orderkey, o_totalprice, CAST(greatest(0, least(100, o_orderkey % 130 - 10)) AS DOUBLE) AS p FROM orders)"""
)
def audio_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(N.percent_to_db(k % 130 - 10), 6).alias("db"), N.loop_count(F.col("o_totalprice"), F.lit(700)).alias("loops"), N.failure_backoff(k % 12 + 1, 2.0).alias("backoff"))
