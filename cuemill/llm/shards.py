"""Contiguous shards of least greatest size, in DataFrame operations only.

Rows of equal text are one atomic group; groups lie in the order of a 64-bit hash of their text (texts that share a hash
count as one group). The smallest feasible shard capacity is found by binary search, each capacity checked greedily along
the running sizes, and the order is cut there.

No list of all groups is ever needed. A leaf is a range of hashes with its total size; the first leaves are
``2 ** FIRST_BITS`` equal ranges. Greedy checks that may cut between leaves only bound the capacity from above, checks
that may cut inside any leaf of several groups from below. Leaves that a cut could fall in between those bounds are split
into ``2 ** NEXT_BITS`` by an aggregation over their rows alone, until both bounds meet: then a capacity less by one byte
is infeasible. Such leaves are a few for each cut, so the driver holds some tens of thousands of sums at any input size.

A group larger than an equal share of what is left fills a shard of its own, and the others are divided among the other
shards; so one large group of copies does not let the rest be uneven. At the smallest capacity, each cut is moved back as
near to equal shares as the rest of the order allows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

FIRST_BITS, NEXT_BITS, KEY_BITS = 14, 6, 64
AT_ONCE, CHUNKS = 1024, 1024
Leaf = tuple[int, int, int, bool]  # first key, bits below its range, bytes, whether all rows have one key


def _sums(rows: DataFrame, below: int) -> list[Leaf]:
    """The leaves of ``rows``: at most one for each range of ``2 ** below`` keys that has rows."""
    found = rows.groupBy(F.shiftright("key", below).alias("range")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"), F.min("key").alias("key")).collect()
    return sorted((r["key"] if r["single"] else r["range"] << below, below, r["size"], r["single"]) for r in found)


def _split(rows: DataFrame, leaves: list[Leaf], wanted: list[Leaf]) -> list[Leaf]:
    """``leaves`` with those ``wanted``, each of several groups, replaced by finer ones."""
    out = sorted(set(leaves) - set(wanted))
    for below in {leaf[1] for leaf in wanted}:
        ranges = [leaf[0] >> below for leaf in wanted if leaf[1] == below]
        out += _sums(rows.filter(F.shiftright("key", below).isin(ranges)), max(below - NEXT_BITS, 0))
    return sorted(out)


class _Order:
    """Running sizes along the leaves, and greedy walks over them."""

    def __init__(self, leaves: list[Leaf]):
        self.leaves = leaves
        self.ends = [0, *accumulate(leaf[2] for leaf in leaves)]
        self.total = self.ends[-1]

    def walk(self, capacity: int, shards: int, inside: bool, start: int = 0) -> list[int]:
        """Places of the cuts when each shard takes as much as fits; ``inside``: also parts of leaves of several groups."""
        cuts = [start]
        for _ in range(shards):
            most = cuts[-1] + capacity
            at = bisect_right(self.ends, most) - 1
            whole = at == len(self.leaves) or not inside or self.leaves[at][3]
            cuts.append(max(cuts[-1], self.ends[at]) if whole else most)
        return cuts

    def least(self, shards: int, inside: bool) -> int:
        """The smallest capacity whose walk reaches the end."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, inside)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, low: int, high: int, shards: int) -> list[Leaf]:
        """Leaves of several groups in which a cut may fall at a capacity from ``low`` to ``high``: the ``AT_ONCE`` largest."""
        found: set[int] = set()
        for a, b in zip(self.walk(low, shards, False)[1:], self.walk(high, shards, True)[1:], strict=True):
            found.update(range(max(bisect_right(self.ends, a) - 1, 0), min(bisect_left(self.ends, b), len(self.leaves))))
        return sorted((self.leaves[i] for i in found if not self.leaves[i][3]), key=lambda leaf: -leaf[2])[:AT_ONCE]

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Leaves before which the order is cut: no shard over ``capacity``, each as near to an equal share of the rest as
        leaves the others enough room."""
        cuts, at = [], 0
        for left in range(shards - 1, 0, -1):
            begin = self.ends[at]
            last = max(bisect_right(self.ends, begin + capacity) - 1, at)
            low, high = at, last
            while low < high:
                middle = (low + high) // 2
                if self.walk(capacity, left, False, self.ends[middle])[-1] >= self.total:
                    high = middle
                else:
                    low = middle + 1
            share = (self.total - begin) / (left + 1)
            near = bisect_right(self.ends, begin + share) - 1
            near += near < last and self.ends[near + 1] - begin - share < begin + share - self.ends[near]
            at = min(max(near, low, at), last)
            cuts.append(at)
        return cuts


def shard_bounds(rows: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Of ``rows`` (key, size): keys of groups that fill a shard each, and first keys of all but the first other shard.

    Fewer keys than shards leave shards empty; without rows there are no bounds.
    """
    leaves, alone = _sums(rows, KEY_BITS - FIRST_BITS), []
    while leaves:
        share = sum(leaf[2] for leaf in leaves) / (shards - len(alone))
        large = [leaf for leaf in leaves if leaf[2] > share]
        if wanted := [leaf for leaf in large if not leaf[3]]:
            leaves = _split(rows, leaves, wanted)
        elif large:
            alone.append(max(large, key=lambda leaf: leaf[2])[0])
            leaves = [leaf for leaf in leaves if leaf[0] != alone[-1]]
        else:
            order, count = _Order(leaves), shards - len(alone)
            low, high = order.least(count, True), order.least(count, False)
            wanted = order.open(low, high, count) if low < high else []
            if not wanted:
                starts = [leaf[0] for leaf in leaves] + [1 << KEY_BITS]
                return alone, [starts[i] for i in order.even_cuts(high, count)]
            leaves = _split(rows, leaves, wanted)
    return alone, []


def _shard(alone: list[int], cuts: list[int]) -> Column:
    after = reduce(add, [(F.col("key") >= cut).cast("int") for cut in cuts if cut < 1 << KEY_BITS - 1], F.lit(len(alone)))
    for i, key in enumerate(alone):
        after = F.when(F.col("key") == key, i).otherwise(after)
    return after.cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row: shards of near equal bytes.

    A row's size is its text's UTF-8 bytes plus 8, 8 for a null. Rows of equal text, null and empty counting as equal,
    share a shard, also a third of all rows. Slots number a shard's rows from 0: rows are dealt to ``CHUNKS`` chunks a
    shard by row, counted, and numbered within their chunk, so no shard meets in one task. Repeated and null ids are rows
    like others. Very long texts are hashed, never moved. Extra columns are ignored. An empty table gives no rows; fewer
    groups than shards leave shards empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    facts = written(facts, "shard-facts")
    chunk = F.pmod(F.xxhash64("row"), F.lit(CHUNKS)).cast("int").alias("chunk")
    placed = facts.select("doc_id", "size", "text_crc32", "row", _shard(*shard_bounds(facts, shards)).alias("shard"), chunk)
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    firsts = counts.select("shard", "chunk", before)
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1)
    return numbered.join(F.broadcast(firsts), ["shard", "chunk"]).select(  # at most shards * CHUNKS rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

