"""A keyed table kept current by changes: only the buckets that a batch touches are written again.

Rows lie in ``buckets`` folders by a hash of their key. A manifest, one small file a version, names the folder of every bucket and
the revision that it is good for; writing it is what makes a version visible, so a reader sees a version whole, and a
batch that is run again after a crash writes the same version again. Files that no kept manifest names are deleted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fanout import Files
from .feeds import change_state

#: Rows of a bucket that one task sorts and writes; a larger bucket has several tasks, so none grows with the table.
ROWS_A_TASK = 500_000


class BucketTable:
    """A maintained table at ``path``; all calls but ``read`` belong to one writer."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema: str, buckets: int = 64, kept: int = 2):
        self.spark, self.path, self.key, self.order, self.schema, self.buckets, self.kept = spark, path.rstrip("/"), key, order, schema, buckets, kept
        self.files, self.names = Files(spark, self.path), spark.createDataFrame([], schema).columns

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("manifest") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "revision", "folders": bucket -> folder, "rows": bucket -> rows}; an empty one before the first version."""
        have = self.versions()
        if not have or version == -1:
            return {"version": -1, "revision": -1, "folders": {}, "rows": {}}
        at = f"{self.path}/manifest/{have[-1] if version is None else version}"
        return json.loads(self.spark.read.text(at, wholetext=True).first()["value"])

    def _rows(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(set(self.manifest(version)["folders"].values())))

    def rows_of(self, keys: DataFrame, version: int) -> DataFrame:
        """The rows of some keys, which may occur repeatedly, in a version, from the buckets that they are in alone."""
        made = self.manifest(version)
        rows = {str(r["b"]): r["count"] for r in keys.groupBy(self._bucket().alias("b")).count().collect()}  # at most ``buckets``
        there = sorted(b for b in rows if b in made["folders"])
        tasks = math.ceil(sum(rows[b] + made.get("rows", {}).get(b, 0) for b in there) / ROWS_A_TASK) or 1
        found = self._rows(sorted(made["folders"][b] for b in there))
        return found.repartition(tasks, self.key).join(keys.select(self.key).repartition(tasks, self.key), self.key, "left_semi")

    def _write(self, rows: DataFrame, version: int, shares: list[int]) -> None:
        """Writes ``rows`` to their buckets, each by its number of tasks in ``shares``, none of which has rows of two buckets."""
        starts = [sum(shares[:b]) for b in range(self.buckets)]
        of = lambda numbers: F.element_at(F.lit(numbers), F.col("bucket") + 1)
        task = of(starts) + F.pmod(F.hash(self.key), F.greatest(of(shares), F.lit(1)))
        placed = rows.withColumn("bucket", self._bucket()).withColumn("__task", task.cast("int")).repartitionById(max(sum(shares), 1), F.col("__task"))
        placed.drop("__task").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")

    def _counts(self, version: int, written) -> dict[str, int]:
        """Rows of the buckets that a version has written."""
        if not written:
            return {}
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{version}")
        return {str(r["bucket"]): r["count"] for r in rows.groupBy("bucket").count().collect()}

    def patch(self, changes: DataFrame, version: int, revision: int | None = None, gone: str | None = None, check: Callable[[DataFrame], None] = lambda rows: None) -> dict:
        """Version ``version``: ``changes`` put in by key, the greatest ``order`` winning (a null is the newest), also over what the table
        has; rows whose boolean column ``gone`` is true are deleted. ``check`` is given the buckets written, before anyone else sees them; if it raises, no
        version is made. The new manifest, with the number of buckets written."""
        last = self.manifest(max((v for v in self.versions() if v < version), default=-1))
        names, late = self.names, F.col(self.order).isNull()
        fresh = changes.select(*names, (F.col(gone) if gone else F.lit(False)).alias("__gone"), F.lit(True).alias("__new"))
        rows = {r["b"]: r["count"] for r in fresh.groupBy(self._bucket().alias("b")).count().collect()}  # at most ``buckets``
        touched = sorted(rows)
        old = self._rows([last["folders"][str(b)] for b in touched if str(b) in last["folders"]])
        both = old.select(*names, F.lit(False).alias("__gone"), F.lit(False).alias("__new")).unionByName(fresh)
        shares = [0] * self.buckets
        for b in touched:
            shares[b] = math.ceil((rows[b] + last.get("rows", {}).get(str(b), 0)) / ROWS_A_TASK)
        order = F.struct(late, self.order, "__new", *[c for c in names if c not in (self.key, self.order)])
        newest = both.repartition(max(sum(shares), 1), self.key).groupBy(self.key).agg(F.max_by(F.struct(*names, "__gone"), order).alias("r")).select("r.*").filter("not __gone").drop("__gone")
        self._write(newest, version, shares)
        written = {n.split("=")[1] for n in self.files.names(f"data/{version}") if n.startswith("bucket=")}
        folders = {b: f for b, f in last["folders"].items() if int(b) not in set(touched)} | {b: f"data/{version}/bucket={b}" for b in written}
        check(self._rows([f"data/{version}/bucket={b}" for b in sorted(written)]))
        counts = {b: n for b, n in last.get("rows", {}).items() if int(b) not in set(touched)} | self._counts(version, written)
        made = {"version": version, "revision": last["revision"] if revision is None else revision, "folders": folders, "rows": counts}
        self.files.write(f"manifest/{version}", json.dumps(made))
        self._vacuum()
        return made | {"touched": len(touched)}

    def roll_back(self, version: int) -> None:
        """Takes the newest version back; the one before it, which must be kept, is the newest again."""
        self.files.delete(f"manifest/{version}")
        self.files.delete(f"data/{version}")

    def rebuild(self, rows: DataFrame, version: int, revision: int) -> dict:
        """Version ``version`` from ``rows`` alone, for when changes were lost."""
        shares = [0] * self.buckets
        for r in rows.groupBy(self._bucket().alias("b")).count().collect():  # at most ``buckets``
            shares[r["b"]] = math.ceil(r["count"] / ROWS_A_TASK)
        newest = rows.repartition(max(sum(shares), 1), self.key).groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), self.order).alias("r")).select("r.*")
        self._write(newest, version, shares)
        folders = {n.split("=")[1]: f"data/{version}/{n}" for n in self.files.names(f"data/{version}") if n.startswith("bucket=")}
        made = {"version": version, "revision": revision, "folders": folders, "rows": self._counts(version, folders)}
        self.files.write(f"manifest/{version}", json.dumps(made))
        self._vacuum()
        return made | {"touched": self.buckets}

    def _vacuum(self) -> None:
        versions = self.versions()
        named = {f for v in versions[-self.kept :] for f in self.manifest(v)["folders"].values()}
        for v in versions[: -self.kept]:
            self.files.delete(f"manifest/{v}")
        for v in self.files.names("data"):
            folders = [f"data/{v}/{n}" for n in self.files.names(f"data/{v}") if n.startswith("bucket=")]
            for folder in set(folders) - named if int(v) < versions[-1] else ():
                self.files.delete(folder)
            if int(v) < versions[-1] and not set(folders) & named:
                self.files.delete(f"data/{v}")

    def poll(self, changes: DataFrame, source: DataFrame, retained: int = 4096) -> tuple[str, dict]:
        """Brings the table to the newest revision of a change table (revision, id): "unchanged", without any work; "patched",
        with the rows of the changed ids in ``source`` (ids that it lacks are deleted); or "rebuilt", where changes after the
        table's revision are no longer retained."""
        have = self.manifest()
        found = change_state(changes, have["revision"], retained).first()
        if found["newest"] <= have["revision"]:
            return "unchanged", have
        if found["refresh"] or have["version"] < 0:
            return "rebuilt", self.rebuild(source.select(*self.names), have["version"] + 1, found["newest"])
        ids = changes.filter((F.col("revision") > have["revision"]) & (F.col("revision") <= found["newest"])).select(F.col("id").alias(self.key)).distinct()
        now = ids.join(source.select(*self.names, F.lit(True).alias("__there")), self.key, "left").withColumn("__absent", F.col("__there").isNull())
        return "patched", self.patch(now, have["version"] + 1, found["newest"], gone="__absent")


def maintain_buckets(stream: DataFrame, table: BucketTable, checkpoint: str, told: Callable[[dict], None] = lambda made: None):
    """A writer that patches ``table`` with each batch of the stream; a batch's number is its version."""
    return stream.writeStream.foreachBatch(lambda batch, number: told(table.patch(batch, number))).option("checkpointLocation", checkpoint)


def accept_current(stream: DataFrame, generations: Callable[[SparkSession], DataFrame], key: str, path: str, checkpoint: str):
    """A writer of those results of the stream whose generation is the present one of their key, by batch folder.

    ``generations`` (key, generation) is read anew for each batch, so a request that was replaced between batches drops the late
    results of the older one; a key without generation has none that count.
    """

    def apply(batch: DataFrame, number: int) -> None:
        now = generations(batch.sparkSession).select(key, F.col("generation").alias("__now"))
        kept = batch.join(now, key).filter(F.col("generation") == F.col("__now")).drop("__now")
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def maintain_totals(stream: DataFrame, table: BucketTable, group: str, values: list[str], path: str, checkpoint: str):
    """A writer that patches ``table`` (keeping two versions at least) and puts what each batch adds to the totals of ``group``, and
    takes back from them, into a folder of the batch: group, rows and the sums of the values.

    A row that changes or moves to another group gives its new state and takes back the old one; one that is older than what the
    table has changes nothing; only the buckets of changed rows are read. Nulls count as 0. A batch that is run again replaces its folder.
    """

    def apply(batch: DataFrame, number: int) -> None:
        keys = batch.select(table.key)
        before = max((v for v in table.versions() if v < number), default=-1)
        table.patch(batch, number)
        side = lambda version, sign: table.rows_of(keys, version).select(group, F.lit(sign).cast("long").alias("rows"), *[(F.coalesce(F.col(v).cast("long"), F.lit(0)) * sign).alias(v) for v in values])
        both = side(number, 1).unionByName(side(before, -1))
        both.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("rows", *values)]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def totals(contributions: DataFrame, group: str) -> DataFrame:
    """The totals of each group that still has rows, from the folders that ``maintain_totals`` wrote."""
    values = [c for c in contributions.columns if c not in (group, "batch")]
    return contributions.groupBy(group).agg(*[F.sum(v).alias(v) for v in values]).filter("rows > 0")
