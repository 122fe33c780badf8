"""The registered queries of the numbered operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, filter_audit, forest, hamming, packing, pii, repair, repeats, revisits, secrets, shards, toxicity
from .shared import new_table_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_along_curve(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return hamming.top_k_hamming(table, F.col("vec_id") % 100 == 0, dims=64, k=10)


def page_captures(pages: DataFrame) -> DataFrame:
    """A capture log from the pages: one full response a page, and one revisit of it under a variant of its URL; some
    revisits come before the response, have a stale tag or have no validator."""
    at = F.col("page_id") * 60
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("type"), "url", F.timestamp_seconds(at).alias("captured"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at.cast("string"), F.lit("last-modified"), F.concat(F.lit("t"), at.cast("string"))).alias("headers"), html.alias("body"),
    )
    later = F.when(F.col("page_id") % 7 == 0, at - 30).otherwise(at + 3600 * (F.col("page_id") % 50 + 1))
    plain = F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), later.cast("string"), F.lit("cache-control"), F.lit("max-age=60"))
    sent = F.when(F.col("page_id") % 11 == 0, plain).otherwise(F.map_concat(plain, F.create_map(F.lit("etag"), F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag)))))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), F.concat(F.regexp_replace("url", "^https?", "HTTPS"), F.when(F.col("url").contains("#"), F.lit("")).otherwise(F.lit("#r"))).alias("url"),
        F.timestamp_seconds(later).alias("captured"), sent.alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return response.unionAll(revisit)


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(page_captures(_table(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "url_key", "state", "original_id", F.array_join(fields, ";").alias("headers"), F.sha2("body", 256).alias("body_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), secrets.labelled_findings(spark))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train_machine(docs, _table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, machine, score_col="score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "tokens")
    repair.write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return repair.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    r = F.col("repeats")
    return found.select("doc_id", r["n_words"].alias("n_words"), r["n_removed"].alias("n_removed"), F.sha2(r["kept"], 256).alias("kept_sha256"))


def op11_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align_corpus(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels"))


def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_revisits": op6_revisits,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_token_files": op8_token_files,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_secrets": op10_secrets,
    "op11_byte_owners": op11_byte_owners,
    "op12_filter_audit": op12_filter_audit,
    "op13_minimax_shards": op13_minimax_shards,
}

#: Words of item-sized windows, joined as lists: the plain statement of the contract, feasible at small scale only.
_OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.words = win.words),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

_OP4_SQL = """
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (e.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
      FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 10
"""

_OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, page_id * 60 AS at, md5(coalesce(html, '')) AS tag,
    CASE WHEN page_id % 7 = 0 THEN page_id * 60 - 30 ELSE page_id * 60 + 3600 * (page_id % 50 + 1) END AS later,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'stale' ELSE md5(coalesce(html, '')) END AS sent,
    regexp_replace(lower(regexp_extract(url, '^[^:]*://([^@/?#]*@)?([^/?#]*)', 2)), CASE WHEN url ILIKE 'http:%' THEN ':80$' ELSE ':443$' END, '') AS host,
    regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '/+$', '') AS path,
    list_filter(string_split(ltrim(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4), '?'), '&'), lambda f: NOT starts_with(f, 'utm_') AND f <> '') AS fields
  FROM pages),
k AS (SELECT *, host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS url_key FROM p),
m AS (SELECT r.page_id, r.url_key, r.later, r.sent, arg_max(o.page_id, o.at * 1000000000 + o.page_id) AS original FROM k r LEFT JOIN k o ON o.url_key = r.url_key AND o.at < r.later GROUP BY ALL),
s AS (
  SELECT m.*, o.at AS old_at, o.body, CASE WHEN m.original IS NULL THEN 'no_original' WHEN m.sent IS NULL THEN 'unverified' WHEN m.sent = o.tag THEN 'resolved' ELSE 'mismatch' END AS state
  FROM m LEFT JOIN k o ON o.page_id = m.original)
SELECT page_id * 2 + 1 AS record_id, url_key, state, CASE WHEN state = 'resolved' THEN original * 2 END AS original_id,
  CASE WHEN state = 'resolved' THEN 'cache-control=max-age=60;content-type=text/html;date=' || later || ';etag=W/"' || sent || '";last-modified=t' || old_at END AS headers,
  CASE WHEN state = 'resolved' THEN sha256(body) END AS body_sha256
FROM s
"""

_OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (
  SELECT doc_id, part, {A: len(words) < 200, B: 100 * len(list_distinct(words)) < 50 * len(words),
    C: 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), D: regexp_matches(text, '[#$%&*|]'), E: coalesce(doc_id > least, false)} AS f
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, f.A::VARCHAR || f.B || f.C || f.D || f.E AS k, [f.A, f.B, f.C, f.D, f.E] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order, [a.i, b.i, c.i, e.i, g.i] AS bits
  FROM letters a JOIN letters b ON b.i <> a.i JOIN letters c ON c.i NOT IN (a.i, b.i) JOIN letters e ON e.i NOT IN (a.i, b.i, c.i) JOIN letters g ON g.i NOT IN (a.i, b.i, c.i, e.i)),
run AS (SELECT part, filter_order, bits, fails, n, good, toxic, coalesce(list_position(list_transform(bits, lambda b: fails[b]), true), 6) AS first FROM d CROSS JOIN o),
steps AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bits[step] AS b, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[bits[step]] AND first < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[bits[step]] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM run CROSS JOIN (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM steps
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1_SQL, "op4_exact_top_k": _OP4_SQL, "op6_revisits": _OP6_SQL, "op12_filter_audit": _OP12_SQL}
