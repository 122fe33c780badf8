"""Publishing queues, logs, files and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import compose_post, fitting_tags, hashtag_list, normalize_caption


def rollup_queue(items: DataFrame, by: str) -> DataFrame:
    """Counts, progress and status of each publishing queue (status, thumbnail, order)."""
    posted, total = F.count_if(F.col("status") == "posted"), F.count("*")
    waiting, broken = F.count_if(F.col("status") == "awaiting_confirmation"), F.count_if(F.col("status").isin("failed", "missing"))
    status = F.when(posted == total, "done").when(waiting > 0, "processing").when(broken > 0, "failed").otherwise("ready")
    return items.groupBy(by).agg(total.alias("item_count"), posted.alias("posted_count"), waiting.alias("waiting_count"), F.bround(posted * 100 / total).cast("int").alias("progress"), status.alias("status"))


def load_queue(items: DataFrame, by: str, files: DataFrame | None = None) -> DataFrame:
    """Items with normal texts, numbered from 0 by (order, created_at); those whose file is not in ``files`` (path) are missing."""
    w = Window.partitionBy(by).orderBy("order", "created_at", "id")
    out = items.withColumn("caption", normalize_caption(F.col("caption"))).withColumn("hashtags", F.array_join(hashtag_list(F.col("hashtags")), " "))
    out = out.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("ready"))).withColumn("order", F.row_number().over(w) - 1)
    if files is None:
        return out
    out = out.join(files.select(F.col("path").alias("file_path"), F.lit(True).alias("__there")).distinct(), "file_path", "left")
    lost = (F.coalesce(F.col("file_path"), F.lit("")) != "") & F.col("__there").isNull()
    return out.withColumn("status", F.when(lost, "missing").otherwise(F.col("status"))).withColumn("error", F.when(lost, "Video file is unavailable.").otherwise(F.col("error"))).drop("__there")


def append_items(queue: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """``new`` items after those there are, numbered on."""
    last = queue.groupBy(by).agg((F.max("order") + 1).alias("__from"))
    placed = new.withColumn("order", F.row_number().over(Window.partitionBy(by).orderBy("created_at", "id")) - 1).join(last, by, "left")
    return queue.unionByName(placed.withColumn("order", (F.col("order") + F.coalesce("__from", F.lit(0))).cast("int")).drop("__from"))


def remove_items(queue: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    left = queue.join(gone.select("id"), "id", "left_anti")
    return left.withColumn("order", F.row_number().over(Window.partitionBy(by).orderBy("order", "id")) - 1)


def update_items(queue: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    """New values where the condition holds; texts come out normal."""
    for name, value in changes.items():
        value = normalize_caption(value) if name == "caption" else F.array_join(hashtag_list(value), " ") if name == "hashtags" else value
        queue = queue.withColumn(name, F.when(where, value).otherwise(F.col(name)))
    return queue


def update_defaults(queue: DataFrame, caption: str, hashtags: str) -> DataFrame:
    """Default texts for all items that are not posted."""
    return update_items(queue, {"caption": F.lit(caption), "hashtags": F.lit(hashtags)}, F.col("status") != "posted")


def with_post_text(queue: DataFrame) -> DataFrame:
    """``post_text`` of caption and hashtags, made in steps so that no expression holds copies of another."""
    out = queue.withColumn("__caption", normalize_caption(F.col("caption"))).withColumn("__tags", fitting_tags(hashtag_list(F.col("hashtags"))))
    return out.withColumn("post_text", compose_post(F.col("__caption"), F.col("__tags"))).drop("__caption", "__tags")


def next_item(queue: DataFrame, by: str) -> DataFrame:
    return queue.filter("status <> 'posted'").groupBy(by).agg(F.min_by(F.struct("id", "order", "status"), F.struct("order", "id")).alias("i")).select(by, "i.*")


def orphans(files: DataFrame, references: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Files that no row names in any of the columns."""
    named = references.select(F.explode(F.array(*columns)).alias(path)).filter(F.col(path).isNotNull()).distinct()
    return files.join(named, path, "left_anti")


def log_tail(lines: DataFrame, order: str, text: str, by: str | None = None, most_lines: int = 800, most_characters: int = 60_000) -> DataFrame:
    """The last lines that fit both limits. A log over all rows is cut to its last ``most_lines`` before any window."""
    if by is None:
        lines, key = lines.orderBy(F.desc(order)).limit(most_lines), F.lit(0)
    else:
        key = F.col(by)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    total = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tail = lines.withColumn("__n", F.row_number().over(w)).withColumn("__size", total - 1)
    return tail.filter((F.col("__n") <= most_lines) & (F.col("__size") <= most_characters)).drop("__n", "__size")


def integrity(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``fault`` of each expected file (key, size, sha256): missing, size or hash; null if it is as expected."""
    found = actual.select(key, F.col("size").alias("__size"), F.col("sha256").alias("__hash"), F.lit(True).alias("__there"))
    fault = F.when(F.col("__there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("__size")), "size").when(F.lower("sha256") != F.lower("__hash"), "hash")
    return expected.join(found, key, "left").select(*expected.columns, fault.alias("fault"))


def signature(*columns: Column) -> Column:
    """SHA-256 of the JSON of some values: what a checkpoint was made from."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def reusable(steps: DataFrame, checkpoints: DataFrame, outputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """``reuse``: the run resumes, the signature is that of the checkpoint, and every output is there and not empty."""
    kept = checkpoints.select(*key, F.col("signature").alias("__kept"))
    there = outputs.groupBy(*key).agg(F.bool_and(F.coalesce(F.col("size"), F.lit(0)) > 0).alias("__whole"))
    out = steps.join(kept, list(key), "left").join(there, list(key), "left")
    return out.withColumn("reuse", F.col("resuming") & F.coalesce(F.col("signature") == F.col("__kept"), F.lit(False)) & F.coalesce("__whole", F.lit(False))).drop("__kept", "__whole")


def mark_checkpoints(rows: DataFrame, step: str, value: Column) -> DataFrame:
    return rows.withColumn("checkpoints", F.map_concat(F.map_filter("checkpoints", lambda k, v: k != step), F.create_map(F.lit(step), value)))


def distinct_first(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def nearest_rank(rows: DataFrame, by: str, value: str, fraction: float) -> DataFrame:
    """The value at half-even rounded place (n - 1) * fraction, by rank, so no group is gathered in an array."""
    w = Window.partitionBy(by)
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("__at", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.filter(F.col("__at") == F.bround((F.col("__n") - 1) * F.lit(fraction)).cast("int")).select(by, value)
