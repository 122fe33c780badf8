"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.sources.shared import new_folder as new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as projects."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "download").otherwise("batch")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_key"), kind.alias("project_type"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as videos."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_key"), F.col("o_orderkey").alias("video_id"), F.when(s == "O", "processing").when(s == "P", "pending").otherwise("done").alias("status"),
        F.when(s == "O", 50).when(s == "P", 0).otherwise(100).alias("progress"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4).cast("int").alias("batch_import_order"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("thumb/"), F.col("o_orderkey").cast("string"))).otherwise("").alias("thumbnail"), F.col("o_orderpriority").alias("language"), F.floor(F.col("o_totalprice")).cast("long").alias("views"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as segments of a user: seconds since 2024, ``value`` seconds long."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("seq"), F.round(start, 3).alias("start"), F.round(start + F.col("value"), 3).alias("end"), F.col("event_type").alias("language"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), "value")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


#: ``segments`` in SQL.
SEGMENTS_SQL = """segments AS (SELECT user_id, event_id AS seq, event_type AS language, event_type || ' ' || event_id AS text, value,
  round((epoch_us(ts) - 1704067200000000) / 1e6, 3) AS "start", round((epoch_us(ts) - 1704067200000000) / 1e6 + value, 3) AS "end" FROM events)"""
VIDEOS_SQL = """videos AS (SELECT o_custkey AS project_key, o_orderkey AS video_id, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'P' THEN 'pending' ELSE 'done' END AS status,
  CASE o_orderstatus WHEN 'O' THEN 50 WHEN 'P' THEN 0 ELSE 100 END AS progress, o_orderdate AS updated_at, o_orderdate AS created_at, o_orderkey % 4 AS batch_import_order,
  CASE WHEN o_orderkey % 3 = 0 THEN 'thumb/' || o_orderkey ELSE '' END AS thumbnail, o_orderpriority AS language, CAST(floor(o_totalprice) AS BIGINT) AS views FROM orders)"""


def wrapped_sql(words: str, width: int) -> str:
    """A list of words as lines of at most ``width`` characters, in SQL."""
    return f"list_reduce({words}, lambda s, w: CASE WHEN s = '' THEN w WHEN length(string_split(s, chr(10))[-1]) + 1 + length(w) > {width} THEN s || chr(10) || w ELSE s || ' ' || w END, '')"
