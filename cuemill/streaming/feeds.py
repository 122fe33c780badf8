"""Change feeds, late results and throttles on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_state(changes: DataFrame, revision: int, retained: int = 4096) -> DataFrame:
    """``newest`` revision of a change table (revision, id) and ``refresh``: whether changes right after ``revision`` are no
    longer retained, so that everything must be refreshed."""
    newest = changes.filter(F.col("revision") > revision).agg(F.coalesce(F.max("revision"), F.lit(revision)).alias("newest"))
    return newest.withColumn("refresh", F.col("newest") - retained > revision)


def changes_since(changes: DataFrame, revision: int, retained: int = 4096) -> DataFrame:
    """``change_state`` and, sorted, the ids changed after ``revision``; nothing after it, or a refresh, gives no ids."""
    newest = change_state(changes, revision, retained)
    wanted = changes.filter(F.col("revision") > revision).join(F.broadcast(newest.filter("not refresh").select(F.lit(True).alias("__few"))), F.lit(True))  # at most ``retained`` revisions
    ids = wanted.agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return newest.join(F.broadcast(ids), F.lit(True)).select("newest", "refresh", "ids")


def current_only(results: DataFrame, generations: DataFrame, key: str) -> DataFrame:
    """Results of the present generation of their key; late ones of an older request go. Works on a stream of results."""
    return results.join(generations.select(key, F.col("generation").alias("__now")), key).filter(F.col("generation") == F.col("__now")).drop("__now")


def throttled(events: DataFrame, key: str, value: str, at: str, seconds: float = 0.25) -> DataFrame:
    """Events whose value is new for their key, or repeats after ``seconds``; state is the last one let through."""
    schema = events.schema

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, when = state.get if state.exists else (None, None)
        for part in parts:
            keep = []
            for v, t in zip(*(part.sort_values(at)[c] for c in (value, at)), strict=True):
                now = pd.Timestamp(t).timestamp()
                keep.append(str(v) != last or when is None or now - when >= seconds)
                if keep[-1]:
                    last, when = str(v), now
            yield part.sort_values(at)[keep]
        state.update((last, when))

    return events.groupBy(key).applyInPandasWithState(step, schema, "last string, at double", "append", GroupStateTimeout.NoTimeout)


def latest_state(events: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The last event of each candidate decides its state; on a stream in complete or update mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("e")).select("e.*")


def is_remembered(ok: Column, at: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether an event is a failure not older than ``ttl_seconds`` at ``now``, to the microsecond; ``at`` and ``now`` of one type."""
    return ~ok & (at >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def remembered_failures(events: DataFrame, key: str, at: str, now: str, ttl_seconds: int) -> DataFrame:
    """Keys whose last failure is not older than ``ttl_seconds`` and was not followed by a success."""
    last = latest_state(events, key, [at])
    return last.filter(is_remembered(F.col("ok"), F.col(at), F.lit(now).cast(events.schema[at].dataType), ttl_seconds)).select(key, at)
