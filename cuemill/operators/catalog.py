"""Project and video catalogue: rollups, settings, order numbers and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECT_LADDER = ("processing", "awaiting_review", "paused", "pending")
AFTER_DONE = ("failed", "cancelled")


def _any(status: Column, value: str) -> Column:
    return F.bool_or(status == value)


def project_status(status: Column, first: Column) -> Column:
    """Aggregate: the status of a project from those of its videos; ``first`` is that of its first one."""
    out = F.when(_any(status, PROJECT_LADDER[0]), PROJECT_LADDER[0])
    for value in PROJECT_LADDER[1:]:
        out = out.when(_any(status, value), value)
    out = out.when(F.bool_and(F.coalesce(status == "done", F.lit(False))), "done")
    for value in AFTER_DONE:
        out = out.when(_any(status, value), value)
    return out.otherwise(first)


def member_order(order: Column, created: Column, key: Column) -> Column:
    """Members of a batch: numbered ones by number, then the rest by creation."""
    n = F.coalesce(order, F.lit(0))
    return F.struct(F.when(n > 0, 0).otherwise(1).alias("late"), n.alias("n"), created.alias("created"), key.alias("key"))


def rollup_projects(projects: DataFrame, videos: DataFrame) -> DataFrame:
    """One row a project: ``projects`` (project_key, project_type) full-outer-merged with the rollup of ``videos``
    (project_key, video_id, status, progress, updated_at, created_at, batch_import_order, thumbnail).

    Videos are aggregated before the join, so a project with a third of all videos costs one partial row a task. A
    project without videos is "ready" if its type is "download", else "empty"; videos of an unknown key make their own.
    """
    place = member_order(F.col("batch_import_order"), F.col("created_at"), F.col("video_id"))
    rolled = videos.groupBy("project_key").agg(
        F.count("*").alias("video_count"), project_status(F.col("status"), F.min_by("status", place)).alias("status"), F.bround(F.avg("progress")).cast("int").alias("progress"),
        F.max("updated_at").alias("updated_at"), F.min_by("thumbnail", F.when(F.coalesce(F.col("thumbnail"), F.lit("")) != "", place)).alias("thumbnail"),
    )
    merged = projects.join(rolled, "project_key", "full_outer")
    empty = F.when(F.col("project_type") == "download", "ready").otherwise("empty")
    return merged.select(
        "project_key", "project_type", F.coalesce("video_count", F.lit(0).cast("long")).alias("video_count"), F.when(F.col("video_count").isNull(), empty).otherwise(F.col("status")).alias("status"),
        F.coalesce("progress", F.lit(0)).alias("progress"), "updated_at", F.coalesce("thumbnail", F.lit("")).alias("thumbnail"),
    )


def status_counts(videos: DataFrame, by: Sequence[str]) -> DataFrame:
    """Completed, pending and paused members, and their mean progress."""
    return videos.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("completed"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "paused").alias("paused"),
        F.bround(F.avg("progress")).cast("int").alias("progress"),
    )


def mixed_or_single(rows: DataFrame, by: str, value: str, mixed: str = "mixed") -> DataFrame:
    """The value that all rows of a group share, or ``mixed``."""
    low, high = F.min(value), F.max(value)
    return rows.groupBy(by).agg(F.when(low == high, low).otherwise(F.lit(mixed)).alias(value))


def most_common(rows: DataFrame, by: str, settings: Sequence[str], position: str) -> DataFrame:
    """The settings that most rows of a group have; of equals those seen first."""
    counted = rows.groupBy(by, *settings).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    return counted.groupBy(by).agg(F.max_by(F.struct(*settings, "n"), F.struct(F.col("n"), (-F.col("seen")).alias("early"))).alias("best")).select(by, "best.*")


def overrides(rows: DataFrame, common: DataFrame, by: str, settings: Sequence[str]) -> DataFrame:
    """``rows`` with ``overridden``: the names of the settings that differ from the group's most common ones."""
    base = common.select(by, F.struct(*settings).alias("__common"))
    names = F.array(*[F.when(~F.col(s).eqNullSafe(F.col("__common")[s]), F.lit(s)) for s in settings])
    return rows.join(base, by).withColumn("overridden", F.array_compact(names)).drop("__common")


def gap_numbering(rows: DataFrame, by: str, order: Sequence[Column], step: int = 1000) -> DataFrame:
    """``rows`` numbered from ``step`` in steps of it, so that others fit between."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)) * step)


def prepend(numbered: DataFrame, new: DataFrame, by: str, order: Sequence[Column], step: int = 1000) -> DataFrame:
    """``new`` rows before those of ``numbered`` in their group: counted down from the first number, or, where that has no
    room, everything numbered again."""
    first = numbered.groupBy(by).agg(F.min("position").alias("__first"))
    placed = new.withColumn("__at", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    size = placed.groupBy(by).agg(F.max("__at").alias("__n"))
    placed = placed.join(first, by, "left").join(size, by).withColumn("position", F.coalesce("__first", F.col("__n") + 1) - F.col("__n") + F.col("__at") - 1)
    both = placed.drop("__at", "__first", "__n").unionByName(numbered, allowMissingColumns=True)
    w = Window.partitionBy(by)
    return both.withColumn("__low", F.min("position").over(w)).withColumn("__again", F.row_number().over(w.orderBy("position")) * step).withColumn("position", F.when(F.col("__low") <= 0, F.col("__again")).otherwise(F.col("position"))).drop("__low", "__again")


def keep_newest(rows: DataFrame, by: str, order: Sequence[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): the ``n`` first of each group in ``order``, and the others."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("__n") <= n).drop("__n"), ranked.filter(F.col("__n") > n).drop("__n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change ("added", "removed" or "changed") and the names of the columns that differ."""
    names = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*names).alias("a")), new.select(key, F.struct(*names).alias("b"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.lit(c)) for c in names]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(key, change.alias("change"), F.when(change == "changed", changed).otherwise(F.array().cast("array<string>")).alias("columns")).filter("change <> 'changed' or size(columns) > 0")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changes`` replaced or added."""
    return current.join(changes, key, "left_anti").unionByName(changes)


def recover(primary: DataFrame, manifests: DataFrame, key: str, root: str) -> DataFrame:
    """``primary`` merged with ``manifests``: manifests win by key, but one whose root another key already has is left out."""
    owned = primary.select(F.col(root).alias("__root"), F.col(key).alias("__key"))
    clash = manifests.join(owned, (F.col(root) == F.col("__root")) & (F.col(key) != F.col("__key")), "left_semi").select(key)
    return upsert(primary, manifests.join(clash, key, "left_anti"), key)


def shared_roots(projects: DataFrame, key: str, root: str) -> DataFrame:
    """Projects whose root another one has too: they must not be deleted with their files."""
    counted = projects.groupBy(root).agg(F.count("*").alias("__n")).filter("__n > 1")
    return projects.join(counted, root, "left_semi").select(key, root)


def apply_settings(rows: DataFrame, queued: DataFrame, key: str, values: dict) -> DataFrame:
    """New values for all rows that are not queued."""
    marked = rows.join(queued.select(key, F.lit(True).alias("__queued")).distinct(), key, "left")
    for name, value in values.items():
        marked = marked.withColumn(name, F.when(F.col("__queued"), F.col(name)).otherwise(F.lit(value)))
    return marked.drop("__queued")


def interrupted_to_paused(videos: DataFrame) -> DataFrame:
    return videos.withColumn("status", F.when(F.col("status") == "processing", "paused").otherwise(F.col("status")))


def find_rows(ids: DataFrame, rows: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The rows of a list of ids in its order; missing ones are left out."""
    return ids.join(rows, key).orderBy(position)


def search(options: DataFrame, text: str, query: str) -> DataFrame:
    """Options whose text holds the query, without regard to case; a blank query gives all."""
    return options.filter(F.lower(text).contains(F.trim(F.lower(F.lit(query)))))
