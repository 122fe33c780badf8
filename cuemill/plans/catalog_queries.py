"""Queries of the catalogue, candidate and publishing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import host_of, platform_of_host, url_key
from cuemill.operators import candidates as C
from cuemill.operators import catalog, publish
from cuemill.streaming.feeds import changes_since as since

from .tables import VIDEOS_SQL, Registry, projects, table, videos

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_ROLLUP = """SELECT project_key, count(*) AS video_count, CAST(round_even(avg(progress), 0) AS INTEGER) AS progress, max(updated_at) AS updated_at,
  CASE WHEN bool_or(status = 'processing') THEN 'processing' WHEN bool_or(status = 'pending') THEN 'pending' WHEN bool_and(status = 'done') THEN 'done' ELSE 'other' END AS status FROM videos GROUP BY project_key"""


_LADDER = "CASE WHEN video_count IS NULL THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'ready' ELSE 'empty' END ELSE status END"


@R.add(f"WITH {VIDEOS_SQL}, r AS ({_ROLLUP}) SELECT p.c_custkey AS project_key, coalesce(r.video_count, 0) AS video_count, {_LADDER} AS status, coalesce(r.progress, 0) AS progress, r.updated_at FROM customer p LEFT JOIN r ON r.project_key = p.c_custkey")
def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = catalog.rollup_projects(projects(spark, sf_dir), videos(spark, sf_dir))
    return rolled.select("project_key", "video_count", "status", "progress", "updated_at")


@R.add(
    f"""WITH {VIDEOS_SQL}, p AS (SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, c_mktsegment FROM customer), r AS ({_ROLLUP}),
t AS (SELECT project_key, thumbnail, row_number() OVER (PARTITION BY project_key ORDER BY CASE WHEN batch_import_order > 0 THEN 0 ELSE 1 END, batch_import_order, created_at, video_id) AS n FROM videos WHERE thumbnail <> '')
SELECT p.c_custkey AS project_key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'download' ELSE 'batch' END AS project_type, coalesce(video_count, 0) AS video_count,
  {_LADDER} AS status, coalesce(progress, 0) AS progress, updated_at, coalesce(thumbnail, '') AS thumbnail
FROM p LEFT JOIN r ON r.project_key = p.c_custkey LEFT JOIN t ON t.project_key = p.c_custkey AND t.n = 1"""
)
def catalog_rollup_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects and as many more without videos."""
    rows = projects(spark, sf_dir)
    return catalog.rollup_projects(rows.unionByName(rows.withColumn("project_key", F.col("project_key") + 10000000)), videos(spark, sf_dir))


@R.add(f"WITH {VIDEOS_SQL} SELECT language, count(*) AS total, count(*) FILTER (status = 'done') AS completed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'paused') AS paused, CAST(round_even(avg(progress), 0) AS INTEGER) AS progress FROM videos GROUP BY language")
def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(videos(spark, sf_dir), ["language"])


@R.add(f"WITH {VIDEOS_SQL} SELECT project_key, CASE WHEN min(language) = max(language) THEN min(language) ELSE 'mixed' END AS language FROM videos GROUP BY project_key")
def mixed_or_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.mixed_or_single(videos(spark, sf_dir), "project_key", "language")


_COMMON = """counted AS (SELECT project_key, language, status, count(*) AS n, min(video_id) AS seen FROM videos GROUP BY ALL),
common AS (SELECT project_key, language, status, n FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY n DESC, seen) AS k FROM counted) WHERE k = 1)"""


@R.add(f"WITH {VIDEOS_SQL}, {_COMMON} SELECT project_key, language, status, n FROM common")
def most_common_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.most_common(videos(spark, sf_dir), "project_key", ["language", "status"], "video_id")


@R.add(
    f"""WITH {VIDEOS_SQL}, {_COMMON} SELECT v.video_id, array_to_string(list_filter([CASE WHEN v.language <> c.language THEN 'language' END, CASE WHEN v.status <> c.status THEN 'status' END], lambda x: x IS NOT NULL), ',') AS overridden
FROM videos v JOIN common c USING (project_key)"""
)
def config_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = videos(spark, sf_dir)
    common = catalog.most_common(rows, "project_key", ["language", "status"], "video_id")
    return catalog.overrides(rows, common, "project_key", ["language", "status"]).select("video_id", F.array_join("overridden", ",").alias("overridden"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey") % 7
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_key"), F.col("o_orderkey").alias("id"), F.when(i < 4, "posted").when(i == 4, "ready").when((i == 5) & (F.col("o_orderkey") % 3 == 0), "awaiting_confirmation").when(i == 6, "failed").otherwise("posted").alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 5).cast("int").alias("order"))


_QUEUE_SQL = """queue AS (SELECT o_custkey AS project_key, o_orderkey AS id, o_orderdate AS created_at, o_orderkey % 5 AS "order",
  CASE WHEN o_orderkey % 7 < 4 THEN 'posted' WHEN o_orderkey % 7 = 4 THEN 'ready' WHEN o_orderkey % 7 = 5 AND o_orderkey % 3 = 0 THEN 'awaiting_confirmation' WHEN o_orderkey % 7 = 6 THEN 'failed' ELSE 'posted' END AS status FROM orders)"""


@R.add(
    f"""WITH {_QUEUE_SQL} SELECT project_key, count(*) AS item_count, count(*) FILTER (status = 'posted') AS posted_count, count(*) FILTER (status = 'awaiting_confirmation') AS waiting_count,
CAST(round_even(count(*) FILTER (status = 'posted') * 100 / count(*), 0) AS INTEGER) AS progress,
CASE WHEN bool_and(status = 'posted') THEN 'done' WHEN bool_or(status = 'awaiting_confirmation') THEN 'processing' WHEN bool_or(status IN ('failed', 'missing')) THEN 'failed' ELSE 'ready' END AS status FROM queue GROUP BY project_key"""
)
def publish_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.rollup_queue(_queue(spark, sf_dir), "project_key")


@R.add(f"""WITH {_QUEUE_SQL} SELECT project_key, id, CAST(row_number() OVER (PARTITION BY project_key ORDER BY "order", created_at, id) - 1 AS INTEGER) AS "order" FROM queue""")
def publish_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _queue(spark, sf_dir).select("*", F.lit("").alias("caption"), F.lit("").alias("hashtags"))
    return publish.load_queue(items, "project_key").select("project_key", "id", "order")


@R.add(f"""WITH {_QUEUE_SQL} SELECT project_key, id, "order", status FROM (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY "order", id) AS n FROM queue WHERE status <> 'posted') WHERE n = 1""")
def publish_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.next_item(_queue(spark, sf_dir), "project_key")


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "imported").when(flag == "R", "failed").when(F.col("l_linenumber") == 1, "duplicate").otherwise("ready")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session_id"), status.alias("status"), (F.col("l_linestatus") == "O").alias("selected"), F.col("l_quantity").cast("int").alias("progress"))


@R.add(
    """WITH s AS (SELECT l_suppkey AS session_id, CASE WHEN l_returnflag = 'A' THEN 'imported' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linenumber = 1 THEN 'duplicate' ELSE 'ready' END AS status, l_linestatus = 'O' AS selected, CAST(trunc(l_quantity) AS INTEGER) AS progress FROM lineitem)
SELECT session_id, count(*) AS total, count(*) FILTER (selected) AS selected, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'downloading') AS downloading, count(*) FILTER (status = 'importing') AS importing,
  count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ready') AS ready, coalesce(CAST(round_even(avg(CASE WHEN status <> 'duplicate' THEN progress END), 0) AS INTEGER), 0) AS progress FROM s GROUP BY session_id"""
)
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.session_metrics(_session(spark, sf_dir), "session_id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("position"), key.cast("string").alias("remote_video_id"), F.concat(F.lit("https://www.youtube.com/watch?v=p"), key.cast("string"), F.lit("&utm=x")).alias("source_url"), F.when(key % 2 == 0, "YouTube").otherwise("TikTok").alias("platform"),
        F.when(key % 6 == 0, "short").when(key % 6 == 2, "long").otherwise("").alias("content_type"), (F.col("p_size") * 8 - 16).alias("duration_seconds"), F.when(key % 9 == 0, None).otherwise(F.floor("p_retailprice")).cast("long").alias("view_count"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("2024"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))).alias("published_at"),
    )


_CANDIDATES_SQL = """c AS (SELECT p_partkey AS position, CAST(p_partkey AS VARCHAR) AS remote_video_id, 'https://www.youtube.com/watch?v=p' || p_partkey || '&utm=x' AS source_url, CASE WHEN p_partkey % 2 = 0 THEN 'YouTube' ELSE 'TikTok' END AS platform,
  CASE WHEN p_partkey % 6 = 0 THEN 'short' WHEN p_partkey % 6 = 2 THEN 'long' ELSE '' END AS content_type, p_size * 8 - 16 AS duration_seconds, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) END AS view_count,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '2024' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS published_at FROM part),
short AS (SELECT * FROM c WHERE CASE WHEN platform = 'YouTube' AND content_type <> '' THEN content_type = 'short' ELSE duration_seconds > 0 AND duration_seconds <= 180 END)"""


@R.add(f"WITH {_CANDIDATES_SQL} SELECT position, view_count, published_at FROM short ORDER BY view_count IS NOT NULL DESC, coalesce(nullif(view_count, 0), -1) DESC, published_at DESC NULLS LAST, position LIMIT 40")
def candidate_topk_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_candidates(_candidates(spark, sf_dir), "short", "popular", 40).select("position", "view_count", "published_at")


@R.add(f"WITH {_CANDIDATES_SQL} SELECT position, published_at FROM short ORDER BY nullif(published_at, '') DESC NULLS LAST, position LIMIT 60")
def candidate_topk_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_candidates(_candidates(spark, sf_dir), "short", "newest", 60).select("position", "published_at")


@R.add(
    f"""WITH {_CANDIDATES_SQL}, known AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'youtube:' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'https://www.youtube.com/watch?v=p' ELSE 'https://youtube.com/watch?v=p' END END || p_partkey AS k FROM part WHERE p_partkey % 4 < 2),
marked AS (SELECT position, lower(platform || ':' || remote_video_id) IN (SELECT k FROM known) OR 'https://www.youtube.com/watch?v=p' || position IN (SELECT k FROM known) AS duplicate FROM c)
SELECT position, duplicate, CASE WHEN duplicate THEN 'duplicate' ELSE 'ready' END AS status FROM marked"""
)
def candidate_mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    host = F.when(key % 3 == 0, "https://WWW.youtube.com/watch?feature=x&v=p").otherwise("https://youtube.com/watch?v=p")
    known = table(spark, sf_dir, "part").filter(key % 4 < 2).select(F.when(key % 2 == 0, F.concat(F.lit("YouTube:"), key.cast("string"))).otherwise(F.concat(host, key.cast("string"))).alias("remote_key"))
    return C.mark_duplicates(_candidates(spark, sf_dir), known).select("position", "duplicate", "status")


@R.add(
    """WITH e AS (SELECT user_id, list({'kept': CAST([] AS BIGINT[]), 'ids': CAST([] AS BIGINT[]), 'urls': CAST([] AS BIGINT[]), 'e': event_id, 'r': event_id * 7919 % 23, 'u': event_id * 104729 % 29} ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, unnest(list_reduce(l, lambda a, b: CASE WHEN list_contains(a.ids, b.r) OR list_contains(a.urls, b.u) THEN {'kept': a.kept, 'ids': a.ids, 'urls': a.urls, 'e': b.e, 'r': b.r, 'u': b.u}
  ELSE {'kept': list_append(a.kept, b.e), 'ids': list_append(a.ids, b.r), 'urls': list_append(a.urls, b.u), 'e': b.e, 'r': b.r, 'u': b.u} END,
  {'kept': CAST([] AS BIGINT[]), 'ids': CAST([] AS BIGINT[]), 'urls': CAST([] AS BIGINT[]), 'e': 0, 'r': 0, 'u': 0}).kept) AS event_id FROM e)
SELECT user_id, event_id, event_id * 7919 % 23 AS remote, event_id * 104729 % 29 AS link FROM f"""
)
def candidate_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By (user, type) of events: few ids and links, so that rows clash in all ways. Tested against a plain fold."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 23).alias("remote"), (F.col("event_id") * 104729 % 29).alias("link"))
    return C.greedy_dedup(events, "user_id", "remote", "link", "event_id")


_URL_SQL = r"""u AS (SELECT page_id, url, trim(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '.') AS host, regexp_replace(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)"""


@R.add(f"WITH {_URL_SQL} SELECT page_id, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS url_key FROM u")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_key(F.col("url")).alias("url_key"))


@R.add(
    f"""WITH {_URL_SQL}, h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'www.youtube.com' WHEN 1 THEN 'vk.com' WHEN 2 THEN 'notx.com' WHEN 3 THEN 'm.x.com' ELSE host END AS host FROM u)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'YouTube' WHEN 1 THEN 'VK' WHEN 3 THEN 'X' ELSE '' END AS platform FROM h"""
)
def host_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 5
    host = F.when(i == 0, "www.youtube.com").when(i == 1, "vk.com").when(i == 2, "notx.com").when(i == 3, "m.x.com").otherwise(host_of(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", platform_of_host(host).alias("platform"))


@R.add("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", ["doc_id"])


@R.add("SELECT o_custkey AS project_key, o_orderkey AS video_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * 1000 AS INTEGER) AS position FROM orders")
def gap_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.gap_numbering(videos(spark, sf_dir), "project_key", [F.col("created_at"), F.col("video_id")]).select("project_key", "video_id", "position")


@R.add(
    """WITH n AS (SELECT o_custkey AS project_key, o_orderkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderkey % 5 <> 0),
w AS (SELECT o_custkey AS project_key, o_orderkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders WHERE o_orderkey % 5 = 0),
b AS (SELECT project_key, video_id, nth * 3 AS position FROM n UNION ALL SELECT w.project_key, w.video_id, coalesce(f.first, w.size + 1) - w.size + w.nth - 1 FROM w LEFT JOIN (SELECT project_key, min(nth * 3) AS first FROM n GROUP BY project_key) f USING (project_key))
SELECT project_key, video_id, CAST(CASE WHEN min(position) OVER (PARTITION BY project_key) <= 0 THEN row_number() OVER (PARTITION BY project_key ORDER BY position) * 3 ELSE position END AS BIGINT) AS position FROM b"""
)
def prepend_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = videos(spark, sf_dir).select("project_key", "video_id")
    numbered = catalog.gap_numbering(rows.filter("video_id % 5 <> 0"), "project_key", [F.col("video_id")], 3)
    out = catalog.prepend(numbered, rows.filter("video_id % 5 = 0"), "project_key", [F.col("video_id")], 3)
    return out.select("project_key", "video_id", F.col("position").cast("long").alias("position"))


@R.add("SELECT o_custkey AS project_key, o_orderkey AS video_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def prune_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keep_newest(videos(spark, sf_dir), "project_key", [F.col("updated_at").desc(), F.col("video_id")], 5)[0].select("project_key", "video_id")


@R.add(
    """WITH old AS (SELECT o_orderkey AS video_id, o_orderstatus AS status, o_orderpriority AS language FROM orders WHERE o_orderkey % 10 <> 1),
new AS (SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderpriority END AS language FROM orders WHERE o_orderkey % 10 <> 2)
SELECT coalesce(o.video_id, n.video_id) AS video_id, CASE WHEN o.video_id IS NULL THEN 'added' WHEN n.video_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN o.video_id IS NULL OR n.video_id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END, CASE WHEN o.language IS DISTINCT FROM n.language THEN 'language' END], lambda x: x IS NOT NULL), ',') END AS columns
FROM old o FULL JOIN new n ON o.video_id = n.video_id WHERE o.video_id IS NULL OR n.video_id IS NULL OR o.status IS DISTINCT FROM n.status OR o.language IS DISTINCT FROM n.language"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("language"))
    new = rows.filter("video_id % 10 <> 2").withColumn("status", F.when(F.col("video_id") % 6 == 0, "X").otherwise(F.col("status"))).withColumn("language", F.when(F.col("video_id") % 15 != 0, F.col("language")))
    return catalog.snapshot_diff(rows.filter("video_id % 10 <> 1"), new, "video_id").withColumn("columns", F.array_join("columns", ","))


@R.add("WITH e AS (SELECT max(event_id) AS newest FROM events) SELECT newest, false AS refresh, (SELECT array_to_string(list_sort(list(DISTINCT user_id)), ',') FROM events, e WHERE event_id > e.newest - 1000 AND event_id > 100) AS ids FROM e")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("event_id")).first()[0]
    found = since(events.select(F.col("event_id").alias("revision"), F.col("user_id").alias("id")), max(newest - 1000, 100))
    return found.withColumn("ids", F.array_join("ids", ","))


@R.add(
    """SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'missing' WHEN doc_id % 7 = 2 THEN 'size' WHEN doc_id % 5 = 1 THEN 'hash' END AS fault, sha256(text) AS sha256 FROM documents"""
)
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    i, digest = F.col("doc_id"), F.sha2("text", 256)
    expected = docs.select("doc_id", F.col("n_chars").alias("size"), digest.alias("sha256"))
    actual = docs.filter(i % 11 != 3).select("doc_id", (F.col("n_chars") + F.when(i % 7 == 2, 1).otherwise(0)).alias("size"), F.when(i % 5 == 1, "0").otherwise(digest).alias("sha256"))
    return publish.integrity(expected, actual, "doc_id").select("doc_id", "fault", "sha256")


@R.add(
    """WITH s AS (SELECT o_orderkey AS id, o_orderstatus <> 'F' AS resuming FROM orders)
SELECT id, resuming AND id % 3 <> 0 AND id % 4 <> 1 AS reuse FROM s"""
)
def checkpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    mark = publish.signature(F.col("id"), F.col("o_orderpriority"))
    steps = orders.select("id", (F.col("o_orderstatus") != "F").alias("resuming"), mark.alias("signature"))
    kept = orders.select("id", F.when(F.col("id") % 3 == 0, "old").otherwise(mark).alias("signature"))
    outputs = orders.select("id", F.explode(F.array(F.lit(5), F.when(F.col("id") % 4 == 1, 0).otherwise(9))).alias("size"))
    return publish.reusable(steps, kept, outputs, ["id"]).select("id", "reuse")


@R.add("SELECT o_custkey AS project_key, o_orderkey AS video_id, o_orderpriority AS language FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.distinct_first(videos(spark, sf_dir), [F.col("project_key"), F.lower("language")], [F.col("created_at"), F.col("video_id")]).select("project_key", "video_id", "language")


@R.add("SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 8 = 0 THEN 'ZH' ELSE o_orderpriority END AS language FROM orders WHERE o_orderkey % 16 <> 5 UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey % 50 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = videos(spark, sf_dir).select("video_id", "language").filter("video_id % 16 <> 5")
    fresh = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select((-F.col("p_partkey")).alias("video_id"), F.lit("new").alias("language"))
    return catalog.upsert(rows, rows.filter("video_id % 8 = 0").withColumn("language", F.lit("ZH")).unionByName(fresh), "video_id")
