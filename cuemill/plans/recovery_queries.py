"""Queries of catalogues that are read from damaged files, replaced and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators import recovery
from cuemill.streaming.maintained import BucketTable

from .tables import Registry, new_folder, table

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_RECORD = "key long, root string, name string"


def _catalogue_files(spark: SparkSession, sf_dir: str) -> tuple:
    """Customers as projects of seven catalogues, a folder each: primary and backup lists, some with a damaged line, and one
    manifest a project, some twice, some with a root that is another's.

    Catalogue 0, 4: intact. 1, 5: the primary is damaged. 2, 6: the backup too. 3: nothing else is left.
    """
    path, k = new_folder(spark), F.col("c_custkey")
    cat = k % 7
    c = table(spark, sf_dir, "customer").select(k.alias("key"), cat.alias("catalogue"), F.concat(F.lit("r"), k.cast("string")).alias("root"), F.col("c_name").alias("name"))
    line = F.to_json(F.struct("key", "root", "name"))
    torn = lambda where: F.when(where, F.substring(line, 1, 20)).otherwise(line).alias("value")
    primary = c.select("catalogue", torn(F.col("catalogue").isin(1, 2, 3, 5, 6) & (F.col("key") % 50 < 7)))
    backup = c.filter("catalogue <> 3").select("catalogue", F.when(F.col("catalogue").isin(2, 6) & (F.col("key") % 40 < 7), '{"key": 1, "name": "x"}').otherwise(line).alias("value"))
    primary.repartition("catalogue").write.partitionBy("catalogue").text(f"{path}/primary")
    backup.repartition("catalogue").write.partitionBy("catalogue").text(f"{path}/backup")
    read = lambda name: recovery.read_records(spark, f"{path}/{name}", _RECORD, ["key", "root"], "catalogue=([0-9]+)")
    m = F.col("key")
    root = F.when((m % 5 == 2) & (m > 7), F.concat(F.lit("r"), (m - 7).cast("string"))).when(m % 5 == 3, F.concat(F.lit("m"), m.cast("string"))).otherwise(F.col("root"))
    once = c.filter("catalogue <> 3 and key % 5 <> 0").select(F.col("catalogue").cast("string").alias("catalogue"), "key", root.alias("root"), F.lit("manifest").alias("name"), (m * 2).alias("seen"))
    twice = once.filter("key % 5 = 4").withColumn("root", F.concat(F.lit("d"), m.cast("string"))).withColumn("seen", F.col("seen") + 1)
    return read("primary"), read("backup"), once.unionByName(twice)


_RECOVERED_SQL = """WITH c AS (SELECT c_custkey AS key, c_custkey % 7 AS cat, 'r' || c_custkey AS root, c_name AS name FROM customer),
primary_bad AS (SELECT DISTINCT cat FROM c WHERE cat IN (1, 2, 3, 5, 6) AND key % 50 < 7), backup_bad AS (SELECT DISTINCT cat FROM c WHERE cat IN (2, 6) AND key % 40 < 7),
m AS (SELECT cat, key, CASE WHEN key % 5 = 2 AND key > 7 THEN 'r' || (key - 7) WHEN key % 5 = 3 THEN 'm' || key ELSE root END AS root FROM c WHERE cat <> 3 AND key % 5 <> 0),
s AS (SELECT cat, CASE WHEN cat NOT IN (SELECT cat FROM primary_bad) THEN 'primary' WHEN cat = 3 THEN 'lost' WHEN cat NOT IN (SELECT cat FROM backup_bad) THEN 'backup' ELSE 'manifests' END AS source FROM (SELECT DISTINCT cat FROM c)),
taken AS (SELECT m.* FROM m JOIN s USING (cat) WHERE source = 'manifests' OR source = 'backup' AND NOT (key % 5 = 2 AND key > 7)),
r AS (SELECT cat, key, root, name FROM c JOIN s USING (cat) WHERE source = 'primary' OR source = 'backup' AND key NOT IN (SELECT key FROM taken) UNION ALL SELECT cat, key, root, 'manifest' FROM taken)
"""


@R.add(_RECOVERED_SQL + "SELECT CAST(cat AS VARCHAR) AS catalogue, key, root, name FROM r")
def recovered_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of each catalogue from the first source that serves."""
    return recovery.recover_catalogues(*_catalogue_files(spark, sf_dir), "key", "root", "seen")[0].select("catalogue", "key", "root", "name")


@R.add(_RECOVERED_SQL + "SELECT CAST(cat AS VARCHAR) AS catalogue, source FROM s")
def catalogue_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each catalogue came from."""
    return recovery.recover_catalogues(*_catalogue_files(spark, sf_dir), "key", "root", "seen")[1]


@R.add(
    """WITH c AS (SELECT c_custkey AS key, c_custkey % 7 AS cat, '{"key":' || c_custkey || ',"root":"r' || c_custkey || '","name":"' || c_name || '"}' AS line FROM customer)
SELECT 'primary' AS source, CAST(cat AS VARCHAR) AS catalogue, left(line, 20) AS raw, 'corrupt' AS reason FROM c WHERE cat IN (1, 2, 3, 5, 6) AND key % 50 < 7
UNION ALL SELECT 'backup', CAST(cat AS VARCHAR), '{"key": 1, "name": "x"}', 'incomplete' FROM c WHERE cat IN (2, 6) AND key % 40 < 7"""
)
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged lines of both lists, kept with the reason."""
    primary, backup, _ = _catalogue_files(spark, sf_dir)
    return primary[1].select(F.lit("primary").alias("source"), "catalogue", "raw", "reason").unionByName(backup[1].select(F.lit("backup").alias("source"), "catalogue", "raw", "reason"))


@R.add(
    """WITH o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'P' THEN 'pending' ELSE 'done' END AS status, o_custkey % 101 AS progress FROM orders)
SELECT k AS video_id, CASE WHEN k % 6 = 0 AND status <> 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN k % 6 = 0 AND status <> 'processing' THEN 0 ELSE progress END AS progress,
CASE WHEN k % 6 = 0 AND status <> 'processing' THEN 'new/' || k ELSE 'old/' || k END AS source, CAST(CASE WHEN k % 6 = 0 AND status <> 'processing' THEN 2 ELSE 1 END AS BIGINT) AS revision, 'rolled back: disk is full' AS first_try FROM o"""
)
def replaced_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sources for a sixth of the videos; a first try fails in its second half and leaves the table as it was."""
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    kept = BucketTable(spark, new_folder(spark), "video_id", "revision", "video_id long, revision long, status string, progress long, source string", buckets=16)
    rows = table(spark, sf_dir, "orders").select(k.alias("video_id"), F.lit(1).cast("long").alias("revision"), F.when(s == "O", "processing").when(s == "P", "pending").otherwise("done").alias("status"), (F.col("o_custkey") % 101).alias("progress"), F.concat(F.lit("old/"), k.cast("string")).alias("source"))
    kept.patch(rows, 0)
    new = rows.filter("video_id % 6 = 0").select("video_id", F.lit(2).cast("long").alias("revision"), F.concat(F.lit("new/"), F.col("video_id").cast("string")).alias("source"))
    reset = {"status": "pending", "progress": 0}

    def filled(staged: DataFrame) -> None:
        if not staged.filter("coalesce(source, '') = ''").isEmpty():
            raise ValueError("a source is empty")

    def full_disk(published: DataFrame) -> None:
        raise OSError("disk is full")

    first, _ = recovery.replace_inputs(kept, new, "video_id", reset, filled, full_disk)
    if kept.read().filter("revision <> 1").count():
        raise ValueError("the old version was changed")
    recovery.replace_inputs(kept, new, "video_id", reset, filled)
    return kept.read().select("video_id", "status", "progress", "source", "revision", F.lit(first).alias("first_try"))


@R.add(
    """WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 'D:/Other/p' || c_custkey WHEN c_custkey % 10 = 1 THEN 'd:\\data\\p' || (c_custkey + 1) WHEN c_custkey % 10 = 3 THEN 'D:/data/p' || (c_custkey + 1) || '/x' || c_custkey ELSE 'D:/data/p' || c_custkey END AS root FROM customer),
q AS (SELECT k, root, lower(replace(root, '\\', '/')) AS place FROM p),
j AS (SELECT a.k, a.root, a.place, count(b.k) AS n FROM q a JOIN q b ON b.place = a.place OR starts_with(b.place, a.place || '/') GROUP BY ALL)
SELECT k AS id, root, CASE WHEN NOT starts_with(replace(root, '\\', '/'), 'D:/data/') THEN 'outside' WHEN n > 1 THEN 'shared' END AS reason FROM j WHERE k % 2 = 0 OR k % 3 = 0 UNION ALL SELECT -1, NULL, 'unknown'""".replace("\\\\", "\\")
)
def deletable_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which projects may go with their files: not those outside their directory, nor those whose root holds another's."""
    k = F.col("c_custkey")
    text = lambda a, n: F.concat(F.lit(a), n.cast("string"))
    root = F.when(k % 9 == 0, text("D:/Other/p", k)).when(k % 10 == 1, text("d:\\data\\p", k + 1)).when(k % 10 == 3, F.concat(text("D:/data/p", k + 1), text("/x", k))).otherwise(text("D:/data/p", k))
    projects = table(spark, sf_dir, "customer").select(k.alias("id"), root.alias("root"), F.lit("D:/data").alias("directory"))
    wanted = projects.filter("id % 2 = 0 or id % 3 = 0").select("id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    return recovery.deletable(projects, wanted, "id", "root", "directory")
