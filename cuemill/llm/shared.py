"""Places that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 10_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local master gets a new folder; a cluster is an error,
    since executors would each write to a folder of their own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if root is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/cuemill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage is cut, and later readers prune its columns."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, such that ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """The intermediate tables of one run of an operator; ``result`` writes its rows and deletes the others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_table_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.clear()
        return out

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def salted_join(rows: DataFrame, table: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """The rows whose key is in ``table`` (key, n: how many of ``rows`` have it, and other columns), joined with it.

    A key with more than one in ``HOT`` of these rows gets a salt for each such share. There are at most ``HOT`` such keys,
    and they alone are broadcast. ``tie`` names columns that tell the rows of a key apart.
    """
    share = max(1000, (table.agg(F.sum("n")).first()[0] or 0) // HOT)
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = table.filter(F.col("n") > share).select(*key, parts.alias("parts"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(*tie), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return salted.join(spread, [*key, "salt"]).drop("salt")


def spread_join(rows: DataFrame, table: DataFrame, key: str, tie: list[str], counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``. Like ``salted_join``, with the frequencies counted here, in ``counted``, if
    that has the keys of ``rows`` and is cheaper to read. Of ``table`` only the rows of hot keys are repeated, once a share.
    """
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    share = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("parts")))  # at most HOT rows
    parts = F.coalesce("parts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*tie), parts).cast("int")).drop("parts")
    spread = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return salted.join(spread, [key, "salt"]).drop("salt")
