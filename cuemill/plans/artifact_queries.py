"""Queries of files, lines, assets and devices, and of projects deleted with their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators import artifacts as A
from cuemill.operators import recovery
from cuemill.sources import files
from cuemill.streaming.maintained import BucketTable

from .tables import Registry, new_folder, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@R.add(
    """WITH j AS (SELECT o_orderkey AS k, '/w/' || o_orderkey AS w FROM orders), f AS (SELECT w || '/a.webm' AS path, k, 1 AS m FROM j WHERE k % 3 = 0 UNION ALL SELECT w || '/b.mp4', k, 2 FROM j WHERE k % 4 = 0 UNION ALL SELECT w || '/c.MKV', k, 3 FROM j WHERE k % 5 = 0 UNION ALL SELECT w || '/d.txt', k, 9 FROM j)
SELECT k, CASE WHEN k % 3 = 0 THEN w || '/a.webm' WHEN k % 2 = 0 AND k % 4 = 0 THEN w || '/b.mp4' ELSE (SELECT arg_max(path, m) FROM f WHERE f.k = j.k AND NOT ends_with(path, '.txt')) END AS path FROM j"""
)
def downloaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each download left: the file it named, with any extension, else the newest."""
    k = F.col("k")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _text("/w/", F.col("o_orderkey")).alias("workspace"))
    at = lambda name: F.concat("workspace", F.lit("/" + name))
    file = lambda where, name, m: jobs.filter(where).select(at(name).alias("path"), F.lit(m).alias("modified"))
    there = file(k % 3 == 0, "a.webm", 1).unionByName(file(k % 4 == 0, "b.mp4", 2)).unionByName(file(k % 5 == 0, "c.MKV", 3)).unionByName(file(k >= 0, "d.txt", 9))
    name = lambda where, n, path: jobs.filter(where).select("k", F.lit(n).alias("position"), path.alias("path"))
    named = name(k >= 0, 0, F.lit("/elsewhere/a.webm")).unionByName(name(k >= 0, 1, at("a.tmp"))).unionByName(name(k % 2 == 0, 2, at("b.mp4"))).unionByName(name(k >= 0, 3, at("d.txt").substr(1, 0)))
    return A.downloaded_file(jobs, named, there, "k", "workspace").select("k", "path")


@R.add(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'final' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'input' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'fallback' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'final' || o_orderkey ELSE 'fallback' || o_orderkey END AS path FROM orders"""
)
def resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each video: the first kind that exists, a place of its own, or what should have been there."""
    k = F.col("o_orderkey")
    kinds = F.map_filter(F.create_map(F.lit("final"), F.when(k % 2 == 0, _text("final", k)).otherwise(""), F.lit("input"), F.when(k % 3 == 0, _text("input", k))), lambda n, v: v.isNotNull())
    v = table(spark, sf_dir, "orders").select(k.alias("k"), kinds.alias("files"))
    there = v.filter("k % 2 = 0 and k % 4 <> 0").select(_text("final", F.col("k")).alias("path")).unionByName(v.filter("k % 3 = 0").select(_text("input", F.col("k")).alias("path"))).unionByName(v.filter("k % 5 = 0").select(_text("fallback", F.col("k")).alias("path")))
    return A.resolved_file(v, there, "k", ["final", "input"], _text("fallback", F.col("k"))).select("k", "path")


@R.add("SELECT '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z] ' || event_type AS line, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id % 4 <> 1 GROUP BY 1")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of known videos added to a log in two goes, and read again."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_folder(spark)
    lines = A.log_lines(e, e.filter("user_id % 4 <> 1"), "user_id", "ts", "event_type")
    half = F.col("user_id") % 2 == 0
    A.append_log(lines.filter(half), path)
    A.append_log(lines.filter(~half), path)
    return files.read_log(spark, path).filter("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@R.add(
    r"""WITH d AS (SELECT doc_id, '{"id":' || doc_id || ',"text":"' || replace(replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"}' AS j FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(j, '([\x00-\x7F]+|[^\x00-\x7F])'), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')) AS line FROM d"""
)
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as events of a worker, in ASCII."""
    plain = F.regexp_replace(F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), "\r", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(A.ascii_json(F.struct(F.col("doc_id").alias("id"), plain.alias("text"))), 256).alias("line"))


@R.add("SELECT p_partkey AS k, 'git_commit=' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ',version=' || p_size ELSE '' END AS fields FROM part")
def build_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    payload = F.map_concat(F.create_map(F.lit("git_commit"), F.col("p_name"), F.lit("user"), F.col("p_brand")), F.when(k % 2 == 0, F.create_map(F.lit("version"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("path"), F.lit("/home"))))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(A.build_information(payload))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "part").select(k.alias("k"), listed.alias("fields"))


@R.add("SELECT device, count(*) AS assets, CAST(sum(p_size) AS BIGINT) AS bytes FROM part JOIN (SELECT unnest(['cpu', 'gpu']) AS device) ON p_partkey % 3 = 0 OR (p_partkey % 3 = 1) = (device = 'gpu') GROUP BY device")
def assets_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    assets = table(spark, sf_dir, "part").select(F.when(k % 3 == 1, "gpu").when(k % 3 == 2, "cpu").alias("device"), F.col("p_size").cast("long").alias("size"))
    count = lambda device, name: A.required_assets(assets, device).agg(F.count("*").alias("assets"), F.sum("size").alias("bytes")).select(F.lit(name).alias("device"), "assets", "bytes")
    return count("gpu", "gpu").unionByName(count("auto", "cpu"))


@R.add(
    """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'gpu' WHEN p_partkey % 5 = 0 THEN 'auto' ELSE 'cpu' END AS want, p_partkey % 7 <> 0 AS cuda, CASE p_partkey % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS ac, CAST(p_partkey % 24 AS BIGINT) * 715827882 AS vram, CAST(p_partkey % 13 AS BIGINT) * 858993459 AS free, CAST(p_partkey % 17 AS BIGINT) * 1288490188 AS ram, 1 + p_partkey % 12 AS cpus FROM part)
SELECT k, CASE WHEN want = 'gpu' THEN cuda AND coalesce(ac, true) AND vram >= 7516192768 AND NOT (free > 0 AND free < 5368709120) AND NOT (ram > 0 AND ram < 8589934592) ELSE NOT (ram > 0 AND ram < 5368709120) END AS ok,
CASE WHEN want = 'gpu' THEN CASE WHEN NOT cuda THEN 'CUDA-compatible NVIDIA GPU was not detected.' WHEN NOT ac THEN 'GPU mode requires AC power for stable processing. Connect the charger and try again.' WHEN vram < 7516192768 THEN printf('GPU mode requires at least 7 GB VRAM; detected %.1f GB.', vram / 1073741824)
  WHEN free > 0 AND free < 5368709120 THEN printf('GPU mode requires at least 5 GB free VRAM; detected %.1f GB free.', free / 1073741824) WHEN ram > 0 AND ram < 8589934592 THEN printf('GPU mode requires at least 8 GB system RAM; detected %.1f GB.', ram / 1073741824) ELSE printf('GPU ready: card, %.0f GB VRAM.', vram / 1073741824) END
  WHEN ram > 0 AND ram < 5368709120 THEN printf('CPU mode requires approximately 6 GB RAM; detected %.1f GB.', ram / 1073741824) ELSE printf('CPU ready: %.0f GB RAM, %d logical processors.', ram / 1073741824, cpus) END AS message FROM p"""
)
def device_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    machine = F.struct(
        (k % 7 != 0).alias("cuda"), F.lit("card").alias("cuda_name"), F.when(k % 11 == 0, False).when(k % 11 != 1, True).alias("ac_powered"), (k % 24 * 715827882).alias("total_vram"), (k % 13 * 858993459).alias("free_vram"), (k % 17 * 1288490188).alias("ram"), (1 + k % 12).alias("cpus"),
    )
    return table(spark, sf_dir, "part").select(k.alias("k"), A.device_verdict(F.when(k % 2 == 0, "gpu").when(k % 5 == 0, "auto").otherwise("cpu"), machine).alias("v")).select("k", "v.ok", "v.message")


@R.add("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 = 0 THEN 0 ELSE floor(value) END, event_id) - 1 AS place FROM events")
def segment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the order of their start, found anew after they were timed."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.floor("value").cast("double")).alias("start"))
    return A.in_time_order(e, "user_id", "start", "event_id").select("event_id", "place")


@R.add(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN 'missing' WHEN o_orderkey % 4 <> 0 THEN 'primary' WHEN o_orderkey % 3 <> 0 THEN 'backup' ELSE 'unreadable' END AS source,
CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 4 <> 0 THEN '{"a":' || o_orderkey || '}' WHEN o_orderkey % 3 <> 0 THEN '{"b":' || o_orderkey || '}' END AS raw FROM orders"""
)
def looked_up_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of videos by id, from the backup where the primary is damaged."""
    k = F.col("id")
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    primary = ids.filter("id % 10 <> 3").select("id", F.when(k % 4 == 0, '{"a": 1').otherwise(_text('{"a":', k, "}")).alias("raw"))
    backup = ids.filter("id % 12 <> 0").select("id", _text('{"b":', k, "}").alias("raw")).unionByName(ids.filter("id % 24 = 0").select("id", F.lit("[1]").alias("raw")))
    return A.looked_up(ids, primary, backup, "id").select("id", "source", "raw")


@R.add("""SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '{"schema_version":2,"n":' || c_custkey || '}' END AS payload FROM customer""")
def valid_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State files of the present version; others, and broken ones, are as if they were not there."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, _text('{"schema_version":2,"n":', k, "}")).when(k % 4 == 1, _text('{"schema_version":1,"n":', k, "}")).when(k % 4 == 2, "[2]").otherwise('{"schema_version":2')
    return table(spark, sf_dir, "customer").select(k.alias("k"), A.state_payload(raw, 2).alias("payload"))


@R.add("SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN (SELECT coalesce(sum(CAST('0x' || h AS BIGINT)), 0) FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h)) % 7 * 0.15::DOUBLE END AS stagger FROM conversations")
def retry_staggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.stagger(F.col("text")).alias("stagger"))


@R.add(
    """SELECT conv_id, count(*) AS segments, 'segment ' || min(turn) FILTER (turn % 5 = 4 OR coalesce(trim(text), '') = '') || ' is missing text' AS fault FROM conversations GROUP BY conv_id"""
)
def untranslated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")))
    return A.untranslated(turns, "conv_id", "turn", "text")


@R.add("SELECT c_custkey AS id, 'D:/data/p' || CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 1 ELSE c_custkey END AS root FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 10 NOT IN (1, 2))")
def deleted_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of projects after a third of them was to be deleted: those that share their files with another one stay."""
    k = F.col("c_custkey")
    schema = "id long, revision long, root string, directory string"
    kept = BucketTable(spark, new_folder(spark), "id", "revision", schema, buckets=16)
    projects = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(1).cast("long").alias("revision"), _text("D:/data/p", F.when(k % 10 == 1, k + 1).otherwise(k)).alias("root"), F.lit("D:/data").alias("directory"))
    kept.patch(projects, 0)
    allowed = recovery.deletable(kept.read(), projects.filter("id % 3 = 0").select("id"), "id", "root", "directory").filter("reason is null")
    gone = kept.read().join(allowed.select("id"), "id", "left_semi").withColumn("revision", F.lit(2).cast("long")).withColumn("gone", F.lit(True))
    kept.patch(gone, 1, gone="gone")
    return kept.read().select("id", "root")
