"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its components. Codes are dealt by id to parts of at most about ``part_rows`` rows, each of
which is indexed once, and every query is sent to every part and streams through its index: one scan of the table, whatever
the number of queries. In an index codes are cut into segments of about log2(rows) bits with a bucket table each. For radius
r = 0, 1, 2 ... all buckets whose segment differs from the query's in exactly r bits are read and their codes verified. A
code at distance d has a segment with at most d // m differing bits, so once radius r is done every code nearer than
m * (r + 1) has been seen; the search stops when k verified neighbours lie below that. Each part sends its k nearest per
query, and a window keeps the k nearest of all. Equal codes share one index entry, so a very common vector costs one
comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

FOUND = "query_id long, neighbor_id long, distance int"


def sign_codes(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of ``dims`` components without nulls, and the packed signs of those."""
    lengths = np.array(pa.compute.list_value_length(vectors).fill_null(-1))
    good = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(good)).flatten().cast(pa.float64())
    bad = np.unique(np.flatnonzero(np.array(flat.is_null())) // dims) if flat.null_count else np.zeros(0, int)
    values = np.asarray(flat.fill_null(0.0)).reshape(-1, dims)
    keep = np.ones(len(good), bool)
    keep[bad] = False
    bits = np.zeros((int(keep.sum()), -(-dims // 64) * 64), np.uint8)
    bits[:, :dims] = values[keep] > 0
    return good[keep], np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class MultiIndex:
    """Codes (n x words of 64 bits) of distinct value, searched exactly."""

    def __init__(self, codes: np.ndarray, dims: int):
        self.codes = codes
        bits = int(np.clip(np.log2(max(len(codes), 2)).round(), 4, 16))
        cuts = [(w, a) for w in range(codes.shape[1]) for a in range(w * 64, min(dims, w * 64 + 64), bits)]
        self.segments = []
        for w, a in cuts:
            size = min(bits, dims - a, (w + 1) * 64 - a)
            value = ((codes[:, w] >> np.uint64(a - 64 * w)) & np.uint64((1 << size) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            edges = np.searchsorted(value[order], np.arange((1 << size) + 1))
            flips = np.arange(1 << size)
            ones = np.bitwise_count(flips)
            self.segments.append((w, a - 64 * w, size, order, edges, [flips[ones == r] for r in range(size + 1)]))

    def search(self, code: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) seen so far when ``enough(places)`` holds for those within the proven distance, or all."""
        seen = np.zeros(len(self.codes), bool)
        places, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(max(s[2] for s in self.segments) + 1):
            fresh = []
            for w, shift, size, order, edges, flips in self.segments:
                if r <= size:
                    value = ((int(code[w]) >> shift) & ((1 << size) - 1)) ^ flips[r]
                    first, n = edges[value], edges[value + 1] - edges[value]
                    first, n = first[n > 0], n[n > 0]
                    at = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    at = at[~seen[at]]
                    seen[at] = True
                    fresh.append(at)
            new = np.concatenate(fresh)
            places = np.concatenate([places, new])
            distances = np.concatenate([distances, np.bitwise_count(self.codes[new] ^ code).sum(axis=1).astype(np.int64)])
            within = distances < len(self.segments) * (r + 1)
            if len(places) == len(self.codes) or enough(places[within]):
                break
        return places, distances


class Part:
    """The codes of one part: distinct ones in an index, the ids of each in one flat array (16 bytes a row and 64 dimensions)."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, dims: int):
        order = np.lexsort((ids, *codes.T[::-1]))
        ids, codes = ids[order], codes[order]
        new = np.ones(len(ids), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
        keep = new.copy()
        keep[1:] |= ids[1:] != ids[:-1]
        self.index = MultiIndex(codes[new], dims)
        self.ids = ids[keep]
        self.starts = np.append(np.flatnonzero(new[keep]), len(self.ids))

    def members(self, place: int, n: int) -> list[int]:
        """The n least ids with a code."""
        return self.ids[self.starts[place] : min(self.starts[place] + n, self.starts[place + 1])].tolist()

    def top(self, query_id: int, code: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k nearest ids other than the query's, each once, by (distance, id)."""

        def enough(places: np.ndarray) -> bool:
            if (self.starts[places + 1] - self.starts[places]).sum() <= k:
                return False
            seen: set[int] = set()
            for p in places.tolist():
                seen.update(self.members(p, k + 1))
                if len(seen - {query_id}) >= k:
                    return True
            return False

        places, distances = self.index.search(code, enough)
        out: dict[int, int] = {}
        for d in np.unique(distances):
            for i in sorted({i for p in places[distances == d].tolist() for i in self.members(p, k + 1)} - {query_id}):
                out.setdefault(i, int(d))
            if len(out) >= k:
                break
        return sorted(out.items(), key=lambda x: (x[1], x[0]))[:k]


def top_k_hamming(table: DataFrame, query_rows: Column, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 10, part_rows: int = 1_000_000) -> DataFrame:
    """query_id, rank, neighbor_id, distance: for each row where ``query_rows`` holds, its k nearest rows of ``table``.

    Ties go to the smaller id. A query's own id is never its neighbour. An id that repeats is listed once per query, with
    its nearest row, and as a query stands for its smallest code. Rows whose id is null, whose vector is null, has a null
    component or another length than ``dims`` are left out. With fewer than k other rows, all are listed; an empty table
    gives no rows. Extra columns are ignored.
    """
    spark = table.sparkSession
    scratch = Scratch(spark)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(query_rows, F.lit(False)).alias("is_query")).filter("id is not null and vector is not null")
    words = -(-dims // 64)

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, codes = sign_codes(batch.column(1), dims)
            good = pa.array(good)
            codes = pa.FixedSizeListArray.from_arrays(pa.array(codes.view(np.int64).ravel()), words).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(2).take(good), codes], names=["id", "is_query", "code"])

    coded = scratch.written(rows.mapInArrow(to_codes, "id long, is_query boolean, code array<long>"), "hamming-codes")
    parts = max(spark.sparkContext.defaultParallelism, -(-coded.count() // part_rows))
    queries = coded.filter("is_query").groupBy("id").agg(F.min("code").alias("code"))
    each = coded.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "code")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "code")
    dealt = each.unionAll(sent).repartition(parts, "part").sortWithinPartitions("part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, part = None, [], None
        for batch in batches:
            at, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            codes = batch.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, words)
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if at[a] != current:
                    current, held, part = at[a], [], None
                if kind[a] == 0:
                    held.append((ids[a:b], codes[a:b]))
                    continue
                if held:
                    part, held = Part(*(np.concatenate(x) for x in zip(*held, strict=True)), dims), []
                if part is None:
                    continue
                found = [(q, i, d) for q, c in zip(ids[a:b].tolist(), codes[a:b], strict=True) for i, d in part.top(q, c, k)]
                q, i, d = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.int32())], names=["query_id", "neighbor_id", "distance"])

    nearest = dealt.mapInArrow(search, FOUND).groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    ranked = nearest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
    return scratch.result(ranked, "hamming-nearest")
