"""Deduplication in order, where a dropped row blocks nothing: each round decides all rows that nothing before them can change.

A row is kept if no row kept before it shares one of its keys. In each round the rows that are the first undecided ones for all
their keys are kept, and the undecided rows that share a key with them are dropped. Rounds are aggregations and joins over
the rows still undecided, so a group of any size, and a key that a third of all rows have, splits like any other join;
there are as many rounds as the longest chain of rows that wait for one another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.sources.shared import written


def _like(rows: DataFrame, other: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """``rows`` joined with ``other`` on equal keys, nulls included; of ``other`` only its other columns stay."""
    renamed = other.withColumnsRenamed({n: f"__k{i}" for i, n in enumerate(key)})
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(key)])
    return rows.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(key))])


def first_accepted(rows: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[str]) -> DataFrame:
    """Of ``rows`` in ``order`` (ties in an order of their own) those that share none of ``keys``, each a list of columns, with a
    row kept before. Nulls are values like others; of rows that are the same in all columns one is kept at most."""
    names = rows.columns
    left = written(rows.withColumn("__row", F.monotonically_increasing_id()))
    kept = None
    while not left.isEmpty():
        at = F.struct(*order, "__row")
        first = left
        for i, key in enumerate(keys):
            least = left.groupBy(*key).agg(F.min(at).alias(f"__least{i}"))
            first = _like(first, least, key, "inner").filter(at == F.col(f"__least{i}")).drop(f"__least{i}")
        now = written(first)
        kept = now if kept is None else kept.unionByName(now)
        for key in keys:
            left = _like(left, now.select(*key), key, "left_anti")
        left = written(left)
    return rows.limit(0) if kept is None else kept.select(*names)
