"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join-free aggregation over the links, each written to the shared folder, so no lineage grows and no
component is ever gathered in one place: only the least neighbour of a node is kept, by an aggregate that combines
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _star(links: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Links each node's larger (or not larger) neighbours to its least neighbour."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components-least")  # written: a join of tables splits a hub's links
    met = both.join(least, "a")
    if large:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller node at most, and those smaller nodes have none."""
    roles = links.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionAll(links.select(F.col("b").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return roles.groupBy("id").agg(F.sum("child").alias("child"), F.max("root").alias("root")).filter("child > 1 or child > 0 and root > 0").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the least id that it is connected with. No links, no rows."""
    scratch, spent = Scratch(links.sparkSession), Scratch(links.sparkSession)
    current = scratch.written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not _are_stars(current):
        scratch, spent = Scratch(links.sparkSession), scratch
        current = scratch.written(_star(_star(current, True, spent), False, spent), "components")
        spent.clear()
    members = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return scratch.result(members.unionAll(members.select(F.col("component").alias("id"), "component").distinct()), "components")
