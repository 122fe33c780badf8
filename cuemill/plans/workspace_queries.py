"""Queries of the working view: queues, lookups, restarts, published sources, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators import candidates as C
from cuemill.operators import catalog, publish
from cuemill.operators import workspace as W

from .tables import VIDEOS_SQL, Registry, projects, table, videos

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add(f"WITH {VIDEOS_SQL} SELECT video_id, CASE WHEN video_id % 5 = 0 OR video_id % 3 <> 0 THEN 'present' ELSE 'legacy' END AS layout FROM videos")
def video_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir).select("video_id", "updated_at")
    current = v.filter("video_id % 5 = 0 or video_id % 3 <> 0").withColumn("layout", F.lit("present"))
    legacy = v.filter("video_id % 3 = 0").withColumn("layout", F.lit("legacy"))
    return W.all_videos(current, legacy).select("video_id", "layout")


@R.add(
    """SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 4 = 0 THEN 'cache/' || o_orderkey WHEN o_orderkey % 6 = 1 THEN 'legacy/' || o_orderkey WHEN o_orderkey % 5 <> 2 THEN 'project/' || o_custkey END AS directory FROM orders"""
)
def video_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir)
    i = F.col("video_id")
    cache = v.filter(i % 2 == 0).select("video_id", F.when(i % 4 == 0, F.concat(F.lit("cache/"), i.cast("string"))).otherwise("").alias("directory"))
    legacy = v.filter(i % 6 == 1).select("video_id", F.concat(F.lit("legacy/"), i.cast("string")).alias("directory"))
    own = v.filter(i % 5 != 2).select("video_id", F.concat(F.lit("project/"), F.col("project_key").cast("string")).alias("directory"))
    return W.resolve_directory(v.select("video_id"), cache, legacy, own)


@R.add(
    """WITH n AS (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer)
SELECT id, CASE WHEN k IN (0, 3) THEN 'light' ELSE 'dark' END AS theme, CASE WHEN k IN (0, 1, 3, 5) THEN 100 ELSE id END AS volume, CASE WHEN k IN (0, 2, 3) THEN true ELSE id % 2 = 0 END AS sounds FROM n"""
)
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings files, some broken, some with missing and unknown fields."""
    k, i = F.col("c_custkey") % 7, F.col("c_custkey")
    theme, volume, sounds = F.lit('"theme":"dark"'), F.concat(F.lit('"volume":'), i.cast("string")), F.concat(F.lit('"sounds":'), (i % 2 == 0).cast("string"))
    body = F.when(k == 0, F.array(F.lit('"unknown":1'))).when(k.isin(1, 5), F.array(theme, sounds)).when(k == 2, F.array(theme, volume, F.lit('"x":[1]'))).otherwise(F.array(theme, volume, sounds))
    raw = F.when(k == 3, "{broken").otherwise(F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")))
    return W.settings(table(spark, sf_dir, "customer").select(i.alias("id"), raw.alias("raw")), {"theme": "light", "volume": 100, "sounds": True})


@R.add("SELECT c_custkey AS id, c_acctbal + 1 AS balance, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer WHERE c_custkey % 11 = 1 AND c_custkey % 3 <> 0")
def settings_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    i = F.col("id")
    new = old.withColumn("balance", F.when(i % 3 == 0, F.col("balance") + 1).otherwise(F.col("balance"))).withColumn("name", F.when((i % 11 == 1) & (i % 3 != 0), F.lit(None)).otherwise(F.col("name")))
    return W.changed_settings(old, new, "id")


@R.add(
    f"""WITH {VIDEOS_SQL} SELECT video_id, CASE status WHEN 'processing' THEN status ELSE 'pending' END AS status, CASE status WHEN 'processing' THEN progress ELSE 0 END AS progress,
CASE status WHEN 'processing' THEN 'step' ELSE 'queued' END AS step, CASE status WHEN 'processing' THEN 'e' END AS error, language FROM videos"""
)
def restart_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir).select("video_id", "status", "progress", F.lit("step").alias("step"), F.lit("e").alias("error"), "language")
    return W.restarted(v)


@R.add(
    """WITH o AS (SELECT o_custkey AS owner, o_orderkey AS id FROM orders), old AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY id) AS revision FROM o WHERE id % 3 = 0),
new AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY id) AS n FROM o WHERE id % 4 = 0)
SELECT owner, revision, id FROM old UNION ALL SELECT owner, coalesce((SELECT max(revision) FROM old WHERE old.owner = new.owner), 0) + n, id FROM new"""
)
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"))
    old = catalog.gap_numbering(o.filter("id % 3 = 0"), "owner", [F.col("id")], step=1).select("owner", F.col("position").cast("long").alias("revision"), "id")
    saved = o.filter("id % 4 = 0")
    return W.with_change(old, saved.union(saved), "owner", "id")


_QUEUE = """v AS (SELECT o_custkey AS owner, o_orderkey AS video_id, o_orderkey % 10 AS k FROM orders), q AS (SELECT owner, video_id, row_number() OVER (PARTITION BY owner ORDER BY video_id) - 1 AS position FROM v WHERE k IN (0, 1, 2)),
active AS (SELECT video_id FROM v WHERE k = 3)"""


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 10).alias("k"))
    queue = catalog.gap_numbering(v.filter("k in (0, 1, 2)"), "owner", [F.col("video_id")], step=1).select("owner", "video_id", (F.col("position") - 1).cast("long").alias("position"))
    return v, queue, v.filter("k = 3").select("video_id")


@R.add(
    f"""WITH {_QUEUE}, fresh AS (SELECT owner, video_id, row_number() OVER (PARTITION BY owner ORDER BY video_id) AS n FROM v WHERE k IN (4, 5))
SELECT owner, video_id, position FROM q UNION ALL SELECT owner, video_id, coalesce((SELECT max(position) FROM q WHERE q.owner = fresh.owner), -1) + n FROM fresh"""
)
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the wanted ids wait already, some are active, and all are asked for twice."""
    v, queue, active = _queue(spark, sf_dir)
    wanted = v.filter("k between 2 and 5").select("owner", "video_id", F.col("video_id").alias("position"))
    return W.enqueue(queue, wanted.union(wanted), active, "owner")


@R.add(f"WITH {_QUEUE} SELECT video_id, 'rest' AS part FROM q WHERE video_id % 10 <> 1 UNION ALL SELECT video_id, 'removed' FROM q WHERE video_id % 10 = 1 UNION ALL SELECT video_id, 'active' FROM active WHERE video_id % 20 = 3")
def queue_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, queue, active = _queue(spark, sf_dir)
    parts = W.detach(queue, active, v.filter("k in (1, 7) or video_id % 20 = 3").select("video_id"))
    return W.tagged_union(*[(p.select("video_id"), name) for p, name in zip(parts, ("rest", "removed", "active"), strict=True)]).withColumnRenamed("content_type", "part")


@R.add(f"WITH {VIDEOS_SQL} SELECT video_id, 'start' AS button FROM videos WHERE status = 'pending' AND video_id % 10 > 2 UNION ALL SELECT video_id, 'resume' FROM videos WHERE status IN ('pending', 'done') AND video_id % 10 > 2")
def batch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, (_, queue, _) = videos(spark, sf_dir), _queue(spark, sf_dir)
    return W.tagged_union((W.resumable(v, queue, ["pending"]).select("video_id"), "start"), (W.resumable(v, queue, ["pending", "done"]).select("video_id"), "resume")).withColumnRenamed("content_type", "button")


@R.add(f"WITH {VIDEOS_SQL} SELECT project_key, bool_or(status = 'processing' OR video_id % 10 <= 2) AS busy FROM videos GROUP BY project_key")
def project_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.busy_projects(videos(spark, sf_dir), _queue(spark, sf_dir)[1])


@R.add("SELECT c_custkey FROM customer WHERE c_custkey % 6 = 2 AND c_mktsegment = 'MACHINERY'")
def project_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.format_string(" Name %d", F.col("c_custkey") % 6).alias("name"), F.initcap("c_mktsegment").alias("directory"))
    return W.matching(rows, F.lit("name 2 "), F.lit("MACHINERY")).select("c_custkey")


@R.add(
    """WITH p AS (SELECT c_custkey % 500 AS n, min(c_custkey) AS only FROM customer GROUP BY c_custkey % 500 HAVING count(*) = 1)
SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 4 = 0 THEN 'k' || o_custkey ELSE 'k' || p.only END AS project_key FROM orders LEFT JOIN p ON p.n = o_custkey % 900"""
)
def video_project_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys, and names that one, several or no project has."""
    p = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("project_key"), F.format_string("P%d", F.col("c_custkey") % 500).alias("name"), F.lit("D:/x").alias("directory"))
    stored = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("k"), F.col("o_custkey").cast("string"))).otherwise("")
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), stored.alias("project_key"), F.format_string("p%d ", F.col("o_custkey") % 900).alias("project_name"), F.lit("d:/X").alias("project_directory"))
    # the least key as text is not the least number, so only names of one project are told apart here
    return W.with_project_key(v, p).select("video_id", "project_key")


@R.add(
    f"""WITH {VIDEOS_SQL}, v AS (SELECT *, CASE project_key % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'batch' ELSE 'download' END AS kind, CASE WHEN project_key % 5 = 0 THEN 'f' || video_id ELSE 'P' || project_key END AS name FROM videos WHERE status = 'done' AND video_id % 7 <> 0),
s AS (SELECT CASE kind WHEN 'batch' THEN 'batch:' || project_key ELSE CAST(video_id AS VARCHAR) END AS source_id, * FROM v WHERE kind <> 'download')
SELECT source_id, min(kind) AS project_type, count(*) AS video_count, arg_min(name, video_id) AS project_name, string_agg(name || ' — f' || video_id || '.mp4', '|' ORDER BY video_id) AS names FROM s GROUP BY source_id"""
)
def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i, p = videos(spark, sf_dir), F.col("video_id").cast("string"), F.col("project_key")
    v = v.select(
        "video_id", p.cast("string").alias("project_key"), "status", F.col("video_id").alias("position"), F.when(p % 5 == 0, "").otherwise(F.concat(F.lit("P"), p.cast("string"))).alias("project_name"), F.concat(F.lit("f"), i, F.lit(".mp4")).alias("original_filename"),
        F.when(p % 3 == 0, "single").when(p % 3 == 1, "batch").otherwise("download").alias("project_type"), F.when(F.col("video_id") % 7 != 0, F.concat(F.lit("out/"), i)).alias("output_path"),
    )
    found = W.publish_sources(v)
    return found.select("source_id", "project_type", "video_count", "project_name", F.array_join(F.transform("sources", lambda s: s["display_name"]), "|").alias("names"))


@R.add(
    f"""WITH {VIDEOS_SQL}, r AS (SELECT project_key, count(*) AS n FROM videos GROUP BY project_key)
SELECT c_custkey AS project_key, CASE WHEN c_custkey % 4 = 0 AND r.n IS NOT NULL THEN r.n ELSE 1 END AS video_count, CASE WHEN c_custkey % 4 = 0 AND r.n IS NOT NULL THEN 'done' ELSE 'ready' END AS status FROM customer LEFT JOIN r ON r.project_key = c_custkey"""
)
def summary_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = projects(spark, sf_dir).select("project_key", F.when(F.col("project_key") % 4 == 0, "publish").otherwise("batch").alias("project_type"), F.lit(1).cast("long").alias("video_count"), F.lit("ready").alias("status"), F.lit(0).alias("progress"))
    queue = publish.rollup_queue(videos(spark, sf_dir).select("project_key", F.lit("posted").alias("status")), "project_key")
    return W.override_summaries(summaries, queue).select("project_key", "video_count", "status")


@R.add(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Rendering video' WHEN 'view' THEN 'Export complete' ELSE CASE WHEN event_id % 2 = 0 THEN 'detail ' || event_id ELSE event_type END END AS label,
CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN '0:00' ELSE CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END END AS elapsed
FROM (SELECT *, event_id * 37 % 9000 AS s FROM events)"""
)
def stage_and_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    step = F.when(F.col("event_type") == "click", "rendering").when(F.col("event_type") == "view", "done").otherwise("x")
    iso = lambda seconds: F.concat(F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    s = i * 37 % 9000
    started, ended = F.when(i % 5 == 0, "").otherwise(iso(F.lit(0))), iso(F.when(i % 7 == 0, -s).otherwise(s))
    return table(spark, sf_dir, "events").select("event_id", W.stage_label(step, F.when(i % 2 == 0, F.concat(F.lit("detail "), i.cast("string"))), F.col("event_type")).alias("label"), W.elapsed_label(started, ended).alias("elapsed"))


@R.add(
    """SELECT p_partkey, CASE WHEN p_size >= 3600 THEN '' ELSE printf('%d:%02d', p_size // 60, p_size % 60) END AS duration, CASE WHEN p_partkey % 3 = 0 THEN '2024-05-' || printf('%02d', p_partkey % 28 + 1) ELSE 'soon' END AS published,
CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE CASE WHEN v >= 1000 THEN replace(printf('%.1fK', v / 1e3), '.0K', 'K') ELSE CAST(v AS VARCHAR) END END AS views FROM (SELECT *, p_partkey % 700 * 7 AS v FROM part)"""
)
def candidate_list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.cast("string").alias("remote_video_id"), F.col("p_name").alias("title"), F.lit("YouTube").alias("platform"), F.col("p_size").alias("duration_seconds"),
        F.when(k % 3 == 0, F.format_string("202405%02d", k % 28 + 1)).otherwise("soon").alias("published_at"), F.when(k % 4 != 0, k % 700 * 7).alias("view_count"),
    )
    return W.candidate_view(rows).select(F.col("remote_video_id").cast("long").alias("p_partkey"), "duration", "published", "views")


@R.add("SELECT o_orderkey AS video_id, CASE WHEN o_custkey % 4 = 0 THEN 'f' || o_orderkey ELSE 'P' || o_custkey END AS project_name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (o_orderkey % 100 + 1) || ' x ' || (o_orderkey % 50 + 1) END AS video_size FROM orders")
def video_list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("video_id")
    v = videos(spark, sf_dir).withColumn("original_filename", F.concat(F.lit("f"), i.cast("string"))).withColumn("project_name", F.when(F.col("project_key") % 4 != 0, F.concat(F.lit("P"), F.col("project_key").cast("string"))))
    v = v.withColumn("video_width", F.when(i % 3 == 0, 0).otherwise(i % 100 + 1)).withColumn("video_height", i % 50 + 1)
    return W.video_view(v).select("video_id", "project_name", "video_size")


@R.add("SELECT 0 AS pos, CAST(NULL AS BIGINT) AS project_key UNION ALL SELECT CAST(n AS INTEGER), c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 40")
def recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_key"), "c_acctbal")
    return W.recent_with_new(rows, "c_acctbal").select("pos", "project_key")


@R.add(
    """SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END WHEN 'view' THEN 'c' ELSE CASE WHEN event_id % 3 = 2 THEN 'e' ELSE 'd' END END AS supported FROM events"""
)
def voice_of_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = spark.createDataFrame([("click", "a", 0), ("click", "b", 1), ("view", "c", 0), ("en", "d", 0), ("en", "e", 1)], "language string, voice string, pos int")
    wanted = F.when(F.col("event_id") % 3 == 0, "b").when(F.col("event_id") % 3 == 1, "x").otherwise("e")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("language"), wanted.alias("voice"))
    return W.supported_voice(rows, voices).select("event_id", "supported")


@R.add("SELECT n_nationkey, lower(n_name || ' Name' || n_nationkey || ' Own') AS search FROM nation WHERE contains(lower(n_name || ' Name' || n_nationkey || ' Own'), 'name1')")
def option_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("code"), F.format_string("Name%d", "n_nationkey").alias("english_name"), F.lit("Own").alias("native_name"))
    return catalog.search(W.option_list(rows), "search", " NAME1 ").select("n_nationkey", "search")


@R.add(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Untitled video' ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN 'YouTube' WHEN 1 THEN 'Bilibili' WHEN 2 THEN 'Generic' ELSE 'Own' END AS platform,
greatest(0, p_size - 10) AS duration_seconds, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'u' END AS uploader FROM part"""
)
def inspected_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    info = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(k % 4 == 0, "youtube:tab").when(k % 4 == 2, "Generic").alias("extractor_key"), F.when(k % 4 == 1, "BiliBiliBangumi").otherwise("").alias("extractor"),
        F.lit("Own").alias("platform"), (F.col("p_size") - 10).alias("duration"), F.when(k % 3 != 0, " u ").alias("uploader"), F.col("p_brand").alias("channel"),
    )
    return W.inspected(info)


@R.add(
    """SELECT CAST(p_partkey AS VARCHAR) AS remote_video_id, CASE WHEN p_partkey % 3 = 0 THEN 'Video ' || p_partkey ELSE p_name END AS title, CASE WHEN p_size * 500 > 10000 THEN p_size * 500 // 1000 ELSE p_size * 500 END AS duration_seconds,
CASE WHEN p_partkey % 6 = 0 THEN '' ELSE strftime(make_timestamp(p_partkey * 86400000000), '%Y%m%d') END AS published_at, CASE p_partkey % 4 WHEN 0 THEN 'http://a/' || p_partkey WHEN 1 THEN 'https://b' ELSE '' END AS thumbnail_url FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 1"""
)
def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    items = table(spark, sf_dir, "part").select(
        k.alias("aweme_id"), F.when(k % 7 == 0, F.array(F.lit("p.jpg"))).alias("images"), F.when(k % 5 == 1, F.array(F.lit("ftp://x"))).otherwise(F.array(F.lit("x"), F.lit("https://v"))).alias("play_urls"), F.when(k % 3 != 0, F.col("p_name")).alias("desc"),
        (F.col("p_size") * 500).alias("duration"), F.lit(0).alias("video_duration"), F.when(k % 6 != 0, k * 86400).alias("create_time"), F.when(k % 4 == 0, F.array(F.lit("data:"), F.concat(F.lit("http://a/"), k.cast("string")))).otherwise(none).alias("cover"), F.when(k % 4 == 1, F.array(F.lit("https://b"))).alias("origin_cover"),
    )
    return W.second_source_candidates(items).select("remote_video_id", "title", "duration_seconds", "published_at", "thumbnail_url")


@R.add("SELECT DISTINCT c_mktsegment AS root FROM customer UNION SELECT DISTINCT p_brand FROM part")
def known_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sorted_union(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("root")), table(spark, sf_dir, "part").select(F.col("p_brand").alias("root")))


@R.add(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'one' || chr(10) || 'two' WHEN 1 THEN '' WHEN 2 THEN 'cap # x' ELSE 'a' || chr(10) || '#b c' END AS caption, CASE o_orderkey % 4 WHEN 0 THEN '#a,#t' || o_orderkey WHEN 1 THEN '#only' ELSE '' END AS tags FROM orders"""
)
def post_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("one\ntwo\n#a #t"), k.cast("string"), F.lit(" "))).when(k % 4 == 1, " #only").when(k % 4 == 2, "cap # x").otherwise("a\n#b c")
    s = W.split_post(text)
    return table(spark, sf_dir, "orders").select(k, s["caption"].alias("caption"), F.array_join(s["tags"], ",").alias("tags"))


@R.add(
    """WITH e AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'd' || event_id WHEN 1 THEN 's' || event_id END AS stage FROM events)
SELECT user_id, coalesce(arg_max(stage, event_id) FILTER (stage IS NOT NULL), 'worker startup') AS stage FROM e GROUP BY user_id"""
)
def worker_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.concat(F.lit('{"event":"diagnostic","detail":{"stage":"d'), i.cast("string"), F.lit('"}}'))).when(i % 5 == 1, F.concat(F.lit('{"event":"status","detail":"s'), i.cast("string"), F.lit('"}')))
    line = line.when(i % 5 == 2, '{"event":"diagnostic","detail":"plain"}').when(i % 5 == 3, "Traceback {").otherwise('{"event":"progress","detail":"x"}')
    return W.last_stages(table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")


@R.add(
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN -1073741819 WHEN 1 THEN 3221225495 WHEN 2 THEN CAST(p_partkey AS BIGINT) END AS code FROM part)
SELECT p_partkey, 'Worker stopped unexpectedly during load. Exit code: ' || coalesce(code, 0) || ' (0x' || CASE p_partkey % 4 WHEN 0 THEN 'C0000005' WHEN 1 THEN 'C0000017' ELSE lpad(printf('%X', coalesce(code, 0)), 8, '0') END || '); classification: '
|| CASE p_partkey % 4 WHEN 0 THEN 'Windows access violation in native code (Torch, CUDA, driver, or a native dependency)' WHEN 1 THEN 'Windows could not reserve enough virtual memory' ELSE 'unexpected worker process termination' END || '; last stage: s.' AS message FROM c"""
)
def worker_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 4 == 0, F.lit(-1073741819)).when(k % 4 == 1, F.lit(3221225495)).when(k % 4 == 2, k)
    return table(spark, sf_dir, "part").select(k, W.exit_text(code, F.lit("load"), F.lit("s")).alias("message"))


@R.add(
    """WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS t, lag(text, 1) OVER w AS a1, lag(text, 2) OVER w AS a2, lag(text, 3) OVER w AS a3, lead(text, 1) OVER w AS b1, lead(text, 2) OVER w AS b2, lead(text, 3) OVER w AS b3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sha256(concat_ws(chr(10), 'P1: ' || nullif(a1, ''), 'P2: ' || nullif(a2, ''), 'P3: ' || nullif(a3, ''), 'N1: ' || nullif(b1, ''), 'N2: ' || nullif(b2, ''), 'N3: ' || nullif(b3, ''), 'TEXT: ' || t)) AS prompt FROM w"""
)
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.prompts(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", F.sha2("prompt", 256).alias("prompt"))


@R.add(
    """SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN 't' || turn END AS translated, CASE WHEN turn % 5 = 4 THEN 'missing' WHEN turn % 5 = 2 THEN 'repeated' END AS fault, conv_id % 3 <> 0 AS needed FROM conversations"""
)
def results_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, " Vietnamese").otherwise("English").alias("source"))
    results = lines.filter("turn % 5 <> 4").select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("translated"))
    return W.with_results(lines, results.union(results.filter("turn % 5 = 2")), ["conv_id", "turn"]).select("conv_id", "turn", "translated", "fault", W.needs_translation(F.col("source"), F.lit("vietnamese")).alias("needed"))


@R.add("SELECT user_id, bool_and(event_type <> 'purchase' OR event_id % 2 = 0) AS current FROM events GROUP BY user_id")
def timing_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when((F.col("event_type") != "purchase") | (F.col("event_id") % 2 == 0), "words")
    return W.timing_is_current(table(spark, sf_dir, "events").withColumn("timing_source", source), "user_id", "words")


@R.add(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'plain.wav' WHEN o_orderkey % 2 = 0 AND o_totalprice > 44 THEN 'bg' || o_orderkey ELSE '' END AS track,
CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'file:///c:/t/' || o_orderkey || '?v=' || o_custkey || '-' || o_orderkey % 1000 END AS thumbnail FROM orders"""
)
def media_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    background = F.when(k % 2 == 0, F.concat(F.lit("bg"), k.cast("string"))).otherwise("")
    path = F.when(k % 5 != 0, F.concat(F.lit("c:\\t\\"), k.cast("string")))
    return table(spark, sf_dir, "orders").select(k, W.mix_track(k % 3 != 0, background, F.col("o_totalprice"), F.lit("plain.wav")).alias("track"), W.thumbnail_url(path, F.col("o_custkey"), k % 1000).alias("thumbnail"))


@R.add(
    """WITH g AS (SELECT user_id, event_type AS language, count(*) AS segments, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, language, segments, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS rank FROM g"""
)
def heard_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.language_groups(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "language", "segments", "rank")


@R.add(
    """WITH r AS (SELECT user_id, event_id, 'f' || event_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(n) || ' unsupported or unreadable item(s):' || chr(10) || chr(10) || string_agg(name, chr(10) ORDER BY k) FILTER (k <= 12) || CASE WHEN max(n) > 12 THEN chr(10) || '... and ' || (max(n) - 12) || ' more' ELSE '' END AS message FROM r GROUP BY user_id"""
)
def rejected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("name", F.concat(F.lit("f"), F.col("event_id").cast("string")))
    return W.rejection_message(rows, "user_id", "event_id", "name")


@R.add(
    f"""WITH {VIDEOS_SQL}, m AS (SELECT project_key, count(*) FILTER (status = 'processing') AS d, count(*) FILTER (status = 'done') AS i, count(*) FILTER (status = 'pending') AS f FROM videos GROUP BY project_key)
SELECT project_key, CASE WHEN d = 0 THEN CASE WHEN f > 0 THEN 'partial' ELSE 'success' END END AS state, CASE WHEN d = 0 THEN 'Imported ' || i || ' videos' || CASE WHEN f > 0 THEN '; ' || f || ' need attention' ELSE '' END END AS message FROM m"""
)
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("status") == "processing", "downloading").when(F.col("status") == "done", "imported").otherwise("failed")
    v = videos(spark, sf_dir).withColumn("status", status).withColumn("selected", F.lit(True))
    return W.final_states(C.session_metrics(v, "project_key")).select("project_key", "state", "message")


@R.add("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING max(l_quantity) < 10 OR max(l_discount) > 0.08")
def broken_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    return W.failed_parts(rows, rows.filter("l_quantity >= 10"), rows.filter("l_discount > 0.08"), key)


@R.add("SELECT p_brand, CAST(sum(p_size * 1000) AS BIGINT) AS total_bytes, CAST(coalesce(sum(p_size * 1000) FILTER (p_partkey % 3 <> 0), 0) AS BIGINT) AS missing_bytes FROM part GROUP BY p_brand")
def asset_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("path"), (F.col("p_size").cast("long") * 1000).alias("size"))
    return W.download_sums(assets, assets.filter("path % 3 = 0"), "p_brand", "path")


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'not locked' WHEN p_partkey % 4 = 1 THEN 'other version' END AS fault FROM part")
def lock_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string("Pack_age.%d", "p_partkey").alias("name"), F.when(F.col("p_partkey") % 4 == 1, "2").when(F.col("p_partkey") % 4 == 2, "1").alias("version"))
    lock = rows.filter("p_partkey % 5 <> 0").select(F.lower(F.regexp_replace("name", "[_.]", "-")).alias("name"), F.lit("1").alias("version"))
    return W.unlocked(rows, lock).select("p_partkey", "fault")


@R.add("SELECT page_id, sha256(encode(CAST(octet_length(b) AS VARCHAR)) || b[1:4000] || b[m:m + 3999] || b[greatest(octet_length(b) - 3999, 1):octet_length(b)]) AS print FROM (SELECT *, CAST(greatest(floor((octet_length(b) - 4000) / 2) + 1, 1) AS BIGINT) AS m FROM (SELECT page_id, encode(html) AS b FROM pages))")
def sampled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", W.fingerprint(F.encode("html", "UTF-8"), 4000).alias("print"))


@R.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN replace(replace(event_type || ' Female', 'Female', 'Nữ'), 'Male', 'Nam') ELSE event_type || ' Female' END AS label FROM events")
def voice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", W.localized_voice(F.concat("event_type", F.lit(" Female")), F.when(F.col("event_id") % 2 == 0, "vi").otherwise("en")).alias("label"))
