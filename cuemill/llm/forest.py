"""Near-duplicate classes by an LSH forest over MinHash signatures.

A document's set of word shingles gets a signature of ``WIDTH`` MinHash values, one byte each. Tree t is the order of all
documents by their signature read from place t * SPAN on; neighbours with a long common prefix are candidates. Depth adapts
to the region: a branch of more than ``crowd`` documents with SPAN values in common is cut at one value more, and again; what
then still is crowded is dense. A branch that ends at the border of a range partition meets its other side in a halo.

Candidates are confirmed on the full sets and links are joined into classes, in two rounds:

1. Every document is paired with the nearest and with one likely document that it meets in any tree: a group of copies of
   any size costs two pairs a document. Confirmed pairs make classes.
2. In branches that hold several classes, all pairs of different classes that the signatures allow are confirmed. Dense
   branches with several classes are settled exactly by a prefix-filtered join on rare shingles (``dense_candidates``).

So no size limit loses a link. What remains is chance, and follows ``percent``: at 80 percent a pair at exactly 0.8 shares
SPAN values in none of the 32 trees with a chance of 5e-8 (3e-4 where branches are cut at SPAN + 2), and fails the bound on
signatures (4.5 standard errors under the threshold) with one of 3e-6. Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import as_text, blocks, text_buffer, whole_groups
from .components import connected_components
from .shared import Scratch, salted_join, spread_join
from .wordscan import NOT_SPACE, Words, mix, scan

TREES, SPAN = 32, 4
WIDTH = TREES * SPAN
KEY = 8  # values of the signature that a tree is sorted by
BUCKETS = 1 << 20
_SIGN = np.uint64(1 << 63)
_SEEDS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row; fewer than k words make one shingle, none make none."""
    starts, hashes = words.grams(k)
    cut = np.searchsorted(starts, words.rows)
    for i, n in enumerate(words.counts.tolist()):
        if n >= k:
            yield np.unique(hashes[cut[i] : cut[i + 1]])
        elif n:
            yield words.spans(words.rows[i : i + 1], words.rows[i + 1 : i + 2])
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """One byte of each MinHash value."""
    least = np.full(WIDTH, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 512):
            part = shingles[a : a + 512, None] * _SEEDS
            part ^= part >> np.uint64(32)
            part *= np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum(least, part.min(axis=0))
    return mix(least).astype(np.uint8).tobytes()


def with_signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    rows = as_text(docs, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            n, a_, b_, s = [], [], [], []
            for a, b in blocks(offsets):
                for shingles in shingle_sets(scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1], NOT_SPACE, lower=True), k):
                    n.append(len(shingles))
                    with np.errstate(over="ignore"):
                        a_.append(int(mix(shingles).sum().astype(np.int64)))
                        b_.append(int(np.bitwise_xor.reduce(mix(shingles * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)) if len(shingles) else 0)
                    s.append(signature(shingles) if len(shingles) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), pa.array(s, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return rows.mapInArrow(sign, SIGNED)


def least_agreement(percent: int) -> int:
    """The number of equal signature bytes that a link keeps but once in some 300,000 times: 4.5 standard errors down."""
    p = percent / 100
    return int(np.ceil(WIDTH * (p - 4.53 * (p * (1 - p) / WIDTH) ** 0.5)))


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _agreement(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many bytes of each signature of ``s`` equal those of each of ``t``."""
    out, same = np.zeros((len(s), len(t)), np.uint8), np.empty((len(s), len(t)), bool)
    for x, y in zip(np.ascontiguousarray(s.T), np.ascontiguousarray(t.T), strict=True):
        np.equal(x[:, None], y[None, :], out=same)
        out += same.view(np.uint8)
    return out


def _leaves(tree: np.ndarray, order: np.ndarray, crowd: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, the leaf of each (numbers rise along the order) and whether it is part of a dense branch."""
    n = len(order)
    leaf, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for level in range(3):
        prefix = order >> np.uint64(64 - 8 * (depth + level))
        new = np.ones(n, bool)
        new[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])
        group = np.cumsum(new) - 1
        small = open_ & (np.bincount(group)[group] <= crowd)
        leaf[small] = level * n + group[small]
        open_ &= ~small
    first = np.flatnonzero(new)[group]
    leaf[open_] = 3 * n + (first + (np.arange(n) - first) // (2 * crowd) * (2 * crowd))[open_]  # a dense branch in windows
    new[1:] = leaf[1:] != leaf[:-1]
    return np.cumsum(new) - 1, open_


def tree_members(nodes: DataFrame, crowd: int, depth: int) -> DataFrame:
    """(chunk, branch, id): who meets whom in which tree. ``branch`` names the dense branch that a chunk is part of, or -1."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(1))
            sig = np.concatenate([sig, sig[:, :KEY]], axis=1)
            for t in range(TREES):
                order = np.ascontiguousarray(sig[:, t * SPAN : t * SPAN + KEY]).view(">u8").ravel().astype(np.uint64) ^ _SIGN
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), t, np.int32)), pa.array(order.view(np.int64)), batch.column(0)], names=["tree", "order", "id"])

    each = nodes.select("id", "signature").mapInArrow(spread, "tree int, order long, id long")
    by = ["tree", "order", F.xxhash64("id", "tree")]  # rows of one order are dealt differently in every tree
    ordered = each.repartitionByRange(*by).sortWithinPartitions(*by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one range partition: 20 bytes a row
        if not held:
            return
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held)
        tree, ids = table.column("tree").to_numpy(), table.column("id").to_numpy()
        order = table.column("order").to_numpy().view(np.uint64) ^ _SIGN
        leaf, dense = _leaves(tree, order, crowd, depth)
        keep = np.flatnonzero(dense | (np.bincount(leaf)[leaf] > 1))
        branch = np.where(dense, (tree.astype(np.int64) << 56) | (order >> np.uint64(64 - 8 * (depth + 2))).astype(np.int64), -1)[keep]
        edge = (tree.astype(np.uint64) << np.uint64(56)) | (order >> np.uint64(64 - 8 * depth))
        head, tail = np.flatnonzero(edge[:crowd] == edge[0]), len(ids) - 1 - np.flatnonzero(edge[::-1][:crowd] == edge[-1])
        rows = np.concatenate([keep, head, tail])
        chunk = np.concatenate([(np.int64(part) << 40) | leaf[keep], np.full(len(head), -1 - part), np.full(len(tail), -2 - part)])
        branch = np.concatenate([branch, np.full(len(head) + len(tail), -1)])
        for a in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (chunk, branch, ids[rows])], names=["chunk", "branch", "id"])

    return ordered.mapInArrow(cut, "chunk long, branch long, id long")


def _compared(dealt: DataFrame, percent: int, pick, schema: str) -> DataFrame:
    """``pick(ids, near, rows)`` of every chunk of ``dealt`` (chunk, id, n, signature and maybe label); ``near`` has the
    equal signature bytes of its members where sizes and signatures allow a link, else 0."""
    least = least_agreement(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(",")]
        for table, cuts in whole_groups(batches, ["chunk"]):
            id_, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            label = table.column("label").to_numpy() if "label" in table.column_names else None
            sig = _signatures(table.column("signature"))
            found = []
            size = np.diff(cuts)
            i = cuts[:-1][size == 2]  # most are pairs: all at once
            both = (sig[i] == sig[i + 1]).sum(axis=1)
            ok = (both >= least) & (100 * np.minimum(n[i], n[i + 1]) >= percent * np.maximum(n[i], n[i + 1])) & (id_[i] != id_[i + 1])
            for a, near in zip(i[ok].tolist(), both[ok].tolist(), strict=True):
                found.append(pick(id_[a : a + 2], np.array([[0, near], [near, 0]], np.uint8), label if label is None else label[a : a + 2]))
            for a, m in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                k = n[a : a + m]
                near = _agreement(sig[a : a + m], sig[a : a + m])
                near[(near < least) | (100 * np.minimum(k[:, None], k[None, :]) < percent * np.maximum(k[:, None], k[None, :]))] = 0
                near[id_[a : a + m, None] == id_[None, a : a + m]] = 0
                if near.any():
                    found.append(pick(id_[a : a + m], near, label if label is None else label[a : a + m]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    return dealt.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(compare, schema)


def nearest_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b: of each document the nearest of all that it meets, and one picked by hash of the likely ones."""
    likely = int(WIDTH * percent / 100) + 4

    def pick(ids: np.ndarray, near: np.ndarray, _) -> tuple[np.ndarray, ...]:
        with np.errstate(over="ignore"):
            u = ids.astype(np.uint64)
            h = mix((u[:, None] + u[None, :]) * np.uint64(0x9E3779B97F4A7C15) ^ (u[:, None] ^ u[None, :])) >> np.uint64(1)
        some = np.where(near >= likely, h, np.uint64(2**63))
        best, other, x = near.argmax(axis=1), some.argmin(axis=1), np.arange(len(ids))
        met = near[x, best] > 0
        other = np.where(near[x, other] >= likely, other, best)
        return ids[met], near[x, best][met].astype(np.int64), ids[best][met], h[x, other][met].astype(np.int64), ids[other][met]

    found = _compared(members.join(nodes, "id"), percent, pick, "id long, near long, best long, h long, other long")
    two = found.groupBy("id").agg(F.max(F.struct("near", "best")).alias("x"), F.min(F.struct("h", "other")).alias("y"))
    pairs = two.select("id", F.explode(F.array("x.best", "y.other")).alias("b"))
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def class_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of different classes that meet in a chunk of ``members`` (chunk, id, label)."""

    def pick(ids: np.ndarray, near: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero(np.triu(near) * (label[:, None] != label[None, :]))
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    mixed = members.groupBy("chunk").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("chunk")
    return _compared(members.join(mixed, "chunk").join(nodes, "id"), percent, pick, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written ``pairs`` whose sets in ``sets`` (id, shingles) have 100 * intersection >= percent * union.

    A set that many pairs name is sent once for each share of them.
    """
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = spread_join(spread_join(pairs, left, "a", ["b"]), right, "b", ["a"], pairs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "left", "right"))
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of ``BUCKETS`` buckets: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for a in range(0, len(raw), 1000):
                total += np.bincount(_bucket(np.frombuffer(b"".join(raw[a : a + 1000]), np.uint64)), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    rows = sets.select("shingles").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def dense_candidates(sets: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, block: int = 4096) -> DataFrame:
    """Pairs a < b of ``nodes`` (id, n, signature, label) of different classes that may be links: a prefix-filtered join.

    All sets are put in one order, rarest shingles first as far as ``_frequencies`` can tell (any one order is exact). Of
    two linked sets of n and m shingles the first n - ceil(n * percent / 100) + 1 share one, and if the first they share
    has places p and q in them, 1 + min(n - p, m - q) >= t * (n + m) with t = percent / (100 + percent). So its *lateness*
    p - (1 - 2t) * n and that of the other set add up to 2 at most. Shingles of one class only, and rows too late for the
    earliest row of their shingle, are dropped. Of a shingle's rows, those outside its largest class are compared with
    blocks of about ``block`` of all, in order of lateness, so hardly more pairs are looked at than the bound allows.
    """
    least, t = least_agreement(percent), percent / (100 + percent)
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                n = len(s) - -(-len(s) * percent // 100) + 1
                first = s[np.lexsort((s, shared.value[_bucket(s)]))[:n]]
                place = np.arange(1, n + 1)
                out.append((np.full(n, id_), np.full(n, label), np.full(n, len(s)), first.view(np.int64), place, place - (1 - 2 * t) * len(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "label", "n", "shingle", "place", "late"])

    rows = sets.join(nodes.select("id", "label"), "id").select("id", "label", "shingles")
    rows = scratch.written(rows.mapInArrow(prefix, "id long, label long, n long, shingle long, place long, late double"), "forest-prefixes")
    lists = rows.groupBy("shingle", "label").agg(F.count("*").alias("c"), F.min("late").alias("early")).groupBy("shingle")
    lists = lists.agg(F.sum("c").alias("df"), F.max_by("label", "c").alias("major"), F.min("early").alias("early"), F.count("*").alias("labels")).filter("labels > 1 and 2 * early <= 2.0001")
    met = rows.join(lists, "shingle").filter("late + early <= 2.0001").withColumn("k", F.ceil(F.col("df") / block).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    right = met.select("shingle", own.alias("block"), F.lit(1).alias("role"), "id", "label", "n", "place", "late", (F.col("label") != F.col("major")).alias("minor"))
    left = met.filter("label <> major").select("shingle", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(0).alias("role"), "id", "label", "n", "place", "late", F.lit(True).alias("minor"))
    dealt = left.unionAll(right).join(nodes.select("id", "signature"), "id").repartition("shingle", "block").sortWithinPartitions("shingle", "block", "role", "late")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["shingle", "block"]):
            role, id_, label, n, place, late, minor = (table.column(c).to_numpy() for c in ("role", "id", "label", "n", "place", "late", "minor"))
            sig = _signatures(table.column("signature"))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                middle = a + int(np.searchsorted(role[a:b], 1))
                count = np.searchsorted(late[middle:b], 2.0001 - late[a:middle], side="right")
                ends = np.cumsum(count)
                at = 0
                while at < middle - a:  # some 100,000 pairs at once
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, side="right")))
                    c = count[at:to]
                    i = np.repeat(np.arange(a + at, a + to), c)
                    j = middle + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                    at = to
                    both = 1 + np.minimum(n[i] - place[i], n[j] - place[j])
                    ok = (label[i] != label[j]) & ((id_[i] < id_[j]) | ~minor[j]) & (100 * both >= percent * (n[i] + n[j] - both))
                    ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                    i, j = i[ok], j[ok]
                    same = (sig[i] == sig[j]).sum(axis=1) >= least
                    x, y = id_[i[same]], id_[j[same]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt.mapInArrow(pair, "a long, b long").distinct()


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, k: int, bits: int = 1 << 24) -> DataFrame:
    """Shingle sets, as bytes of sorted hashes, of the rows whose id is in ``wanted`` (id), without a shuffle of texts.

    A bitmap over hashed ids, at most ``bits`` / 64 rows of 16 bytes however many ids there are, is broadcast and keeps out
    most others. Those that share a bit with a wanted id come along; the joins by id that follow ignore them. With ``bits``
    some ten times the number of wanted ids they are few.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    bit = lambda: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))")
    words = wanted.select(F.floor(at / 64).alias("w"), bit().alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = as_text(docs, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = rows.withColumn("w", F.floor(at / 64)).join(F.broadcast(words), "w").filter(F.col("b").bitwiseAND(bit()) != 0).select("id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            out = [s.tobytes() for a, b in blocks(offsets) for s in shingle_sets(scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1], NOT_SPACE, lower=True), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(make, "id long, shingles binary").filter("length(shingles) > 0")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, crowd: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Rows are linked when their sets of ``k``-word shingles (A-Z lower-cased; a text with fewer words is one shingle) have a
    Jaccard similarity of ``percent`` or more; component_id is the smallest doc_id reachable. A null, empty or wordless
    text has no shingle and is linked with nothing. Rows that share an id stand for one node; a row without id is never
    linked and has no component, but is kept. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    depth = SPAN if percent >= 70 else SPAN // 2
    signed = scratch.written(with_signatures(docs, id_col, text_col, k), "forest-signed")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    same_set = ["set_a", "set_b", "n_shingles"]
    nodes = scratch.written(named.groupBy(*same_set).agg(F.min("doc_id").alias("id"), F.any_value("signature").alias("signature")), "forest-nodes")

    trees = nodes.select("id", F.col("n_shingles").alias("n"), "signature")
    members = scratch.written(tree_members(trees, crowd, depth), "forest-members")
    first = scratch.written(nearest_pairs(members, trees, percent), "forest-pairs")
    sets = scratch.written(_sets(docs, id_col, text_col, _ids(first), k), "forest-sets")
    links = scratch.written(confirmed(first, sets, percent), "forest-links")

    known = scratch.written(connected_components(links), "forest-known")
    labelled = members.join(known, "id", "left").select("chunk", "branch", "id", F.coalesce("component", "id").alias("label"))
    labelled = scratch.written(labelled, "forest-labelled")
    second = class_pairs(labelled.filter("branch = -1").drop("branch"), trees, percent)
    mixed = labelled.filter("branch <> -1").groupBy("branch").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    mixed = scratch.written(mixed.filter("x < y").select("branch", "n"), "forest-mixed")
    dense = scratch.written(salted_join(labelled, mixed, ["branch"], ["id"]).select("id", "label").distinct(), "forest-dense")
    if not dense.isEmpty():
        crowded = scratch.written(_sets(docs, id_col, text_col, dense, k).join(dense.select("id"), "id", "left_semi"), "forest-sets")
        second = second.unionAll(dense_candidates(crowded, trees.join(dense, "id"), percent, scratch)).distinct()
    second = scratch.written(second.join(first, ["a", "b"], "left_anti"), "forest-pairs")
    sets = scratch.written(_sets(docs, id_col, text_col, _ids(second), k), "forest-sets")
    more = scratch.written(confirmed(second, sets, percent), "forest-links")

    repeated = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")  # an id on several rows joins their classes
    shared = named.join(repeated, "doc_id", "left_semi").join(nodes.select(*same_set, "id"), same_set).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    labels = connected_components(links.unionAll(more).unionAll(shared))

    classes = nodes.select(*same_set, "id").join(labels, "id", "left").select(*same_set, F.coalesce("component", "id").alias("component_id"))
    rows = named.select("doc_id", *same_set).join(classes, same_set).select("doc_id", "n_shingles", "component_id")
    lone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return scratch.result(rows.unionAll(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
