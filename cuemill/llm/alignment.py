"""Alignment of two tokenizers' tokens over the bytes of a text.

Each byte of a block of texts gets its owners: the token of A and the token of B that it lies in, made by repeating token
indices over their bytes. Places where the pair of owners changes start an overlap of two tokens; places where both
owners change are cuts, which part a text into groups of tokens that cover the same bytes. The two tokens that end at a
cut are linked.

Counts of linked id pairs over all texts are aggregated by Spark from partial counts of each task. To bring them back to
the texts, the most frequent pairs, at most ``FREQUENT`` of them, are broadcast and looked up where the texts are; the
other pairs, each less frequent than any of those, are joined by a shuffle. So nothing that grows with the vocabularies'
product is broadcast, and no frequent pair is a join key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import as_text, blocks, text_buffer
from .shared import Scratch
from .tokens import Encoder, encoder, piece_encoder

FREQUENT = 1 << 20
HELD_PAIRS = 1 << 21
BLOCK = 2 << 20
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
OVERLAPS = "doc_id long, a_index long, a_id long, b_index long, b_id long, start long, end long, ends_group boolean"


class _Tokens:
    """The bytes of each id of one vocabulary, laid one after another."""

    def __init__(self, known: Encoder):
        table = known.token_bytes()
        self.size = np.fromiter(map(len, table), np.int32, len(table))
        self.first = np.cumsum(self.size, dtype=np.int64) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        return self.flat[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Aligned:
    """Tokens of a block of texts whose bytes they tile; rows without tokens have none."""

    ids: tuple[np.ndarray, np.ndarray]  # of A and B, all rows one after another
    counts: tuple[np.ndarray, np.ndarray]  # tokens of each row
    overlap: np.ndarray  # first byte of each overlap
    owners: tuple[np.ndarray, np.ndarray]  # token index of each byte
    cut: np.ndarray  # last byte of each group
    row_ends: np.ndarray  # bytes of the rows so far


def _row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def align_block(raw: np.ndarray, offsets: np.ndarray, ids: tuple[list[bytes], list[bytes]], tokens: tuple[_Tokens, _Tokens]) -> Aligned:
    """Owners, overlaps and cuts of a block of texts (each with the space before it; one of no bytes has no tokens)."""
    counts = tuple(np.fromiter(map(len, side), np.int64, len(side)) // 4 for side in ids)
    flat = tuple(np.frombuffer(b"".join(side), "<u4") for side in ids)
    size = np.diff(offsets)
    keep = size > 0
    for side in (0, 1):
        keep &= _row_sums(tokens[side].size[flat[side]], counts[side]) == size

    def only(rows: np.ndarray) -> None:
        nonlocal flat, counts, raw, size
        if not rows.all():
            flat = tuple(f[np.repeat(rows, c)] for f, c in zip(flat, counts, strict=True))
            counts = tuple(np.where(rows, c, 0) for c in counts)
            raw, size = raw[np.repeat(rows, size)], np.where(rows, size, 0)

    only(keep)
    wrong = np.zeros(len(raw), bool)
    for side in (0, 1):
        wrong |= tokens[side].spelled(flat[side]) != raw
    if wrong.any():
        bad = np.unique(np.searchsorted(np.cumsum(size), np.flatnonzero(wrong), side="right"))
        only(~np.isin(np.arange(len(size)), bad))
    owners = tuple(np.repeat(np.arange(len(f), dtype=np.int32), tokens[side].size[f]) for side, f in enumerate(flat))
    new = tuple(o[1:] != o[:-1] for o in owners)
    last = np.array([len(raw) - 1] if len(raw) else [], np.int64)
    overlap = np.flatnonzero(np.concatenate([[True] if len(raw) else [], new[0] | new[1]]))
    return Aligned(flat, counts, overlap, owners, np.concatenate([np.flatnonzero(new[0] & new[1]), last]), np.cumsum(size))


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``n``, each with room for a separator in rows of one width, and their lengths."""
    shown = [str(i) for i in range(n)]
    width = len(shown[-1]) + 1
    return np.frombuffer("".join(s.ljust(width) for s in shown).encode(), np.uint8), np.fromiter(map(len, shown), np.int64, n)


def group_texts(found: Aligned, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Of each row ``a1,a2|b1;a3|b2,b3``: decimal ids, those of A before the bar, groups parted by semicolons."""
    table, length = digits
    (a, b), (owner_a, owner_b) = found.ids, found.owners
    link_a, link_b = owner_a[found.cut].astype(np.int64), owner_b[found.cut].astype(np.int64)
    place_a, place_b = np.arange(len(a)), np.arange(len(b))
    place_a = place_a + np.concatenate([[0], link_b + 1])[np.searchsorted(link_a, place_a)]
    place_b = place_b + (link_a + 1)[np.searchsorted(link_b, place_b)]
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[link_a]], mark[place_b[link_b]] = ord("|"), ord(";")
    size = length[ids] + 1
    ends = np.cumsum(size)
    width = len(table) // len(length)
    out = table[np.repeat(ids * width - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    out[ends - 1] = mark
    row_ends = np.concatenate([[0], ends])[np.cumsum(found.counts[0] + found.counts[1])]
    text = out.tobytes()
    return [text[x : y - 1] if y > x else b"" for x, y in zip([0, *row_ends[:-1].tolist()], row_ends.tolist(), strict=True)]


def _block_rows(docs: DataFrame, a_path: str, b_path: str, columns: list[str], text_col: str, schema: str, make) -> DataFrame:
    """``make(other columns, aligned block, token tables)`` for blocks of rows, each text with a space before it."""
    text = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col))).otherwise(F.lit(""))
    rows = docs.select(*columns, text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoder(a_path, True, plain=True), piece_encoder(b_path)
        tokens = _Tokens(a), _Tokens(b)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(len(columns)))
            for x, y in blocks(offsets, BLOCK):
                part, edges = raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                ids = a._block(part, edges), b._block(part, edges)
                yield from make(batch.slice(x, y - x), align_block(part, edges, ids, tokens), tokens)

    return rows.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked id pairs (unsigned 64-bit
    numbers a * 2**32 + b in ascending order) with how often each is linked there (unsigned 32-bit numbers).

    A null or empty text, or one that the tokens do not spell, has no tokens: zeros, and the empty string for the hash.
    Every row counts, repeated and null ids included; extra columns are ignored; an empty table gives no rows. A text is
    held whole with some 30 bytes for each of its own.
    """
    rows = as_text(docs, text_col).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__body"))
    digits: list = []

    def make(batch: pa.RecordBatch, found: Aligned, tokens: tuple[_Tokens, _Tokens]) -> Iterator[pa.RecordBatch]:
        if not digits:
            digits.append(_decimals(max(len(t.size) for t in tokens)))
        texts = group_texts(found, digits[0])
        row = np.searchsorted(found.row_ends, found.cut, side="right")
        n_groups = np.bincount(row, minlength=batch.num_rows)
        pair = found.ids[0][found.owners[0][found.cut]].astype(np.uint64) << np.uint64(32) | found.ids[1][found.owners[1][found.cut]]
        order = np.lexsort((pair, row))
        pair, row = pair[order], row[order]
        first = np.flatnonzero(np.concatenate([[True] if len(pair) else [], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])]))
        times = np.diff(np.append(first, len(pair))).astype("<u4")
        bounds = np.searchsorted(row[first], np.arange(batch.num_rows + 1)).tolist()
        pairs, many = pair[first].tobytes(), times.tobytes()
        cut = lambda data, width: pa.array([data[x * width : y * width] for x, y in zip(bounds, bounds[1:])], pa.binary())  # noqa: B905, E731
        hashes = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
        n = [pa.array(c, pa.int64()) for c in (*found.counts, n_groups, n_groups)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *n, hashes, cut(pairs, 8), cut(many, 4)], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return _block_rows(rows, a_path, b_path, ["row", "doc_id"], "__body", ALIGNED, make)


def token_overlaps(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each two tokens that share bytes: doc_id, a_index, a_id, b_index, b_id (indices in their text), start,
    end (bytes of the text with the space before it, end exclusive), ends_group (both tokens end there: they are linked).

    Texts without tokens, as in ``align_tokens``, have no rows.
    """
    rows = as_text(docs, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__body"))

    def make(batch: pa.RecordBatch, found: Aligned, tokens: tuple[_Tokens, _Tokens]) -> Iterator[pa.RecordBatch]:
        at, row = found.overlap, np.searchsorted(found.row_ends, found.overlap, side="right")
        columns = [batch.column(0).take(pa.array(row))]
        for side in (0, 1):
            owner = found.owners[side][at].astype(np.int64)
            columns += [pa.array(owner - (np.cumsum(found.counts[side]) - found.counts[side])[row]), pa.array(found.ids[side][owner].astype(np.int64))]
        begin = (np.concatenate([[0], found.row_ends])[:-1])[row]
        ends = np.append(at[1:], found.row_ends[-1:])[: len(at)]
        columns += [pa.array(at - begin), pa.array(ends - begin), pa.array(np.isin(ends - 1, found.cut))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_index", "a_id", "b_index", "b_id", "start", "end", "ends_group"])

    return _block_rows(rows, a_path, b_path, ["doc_id"], "__body", OVERLAPS, make)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of the rows of a batch, one after another, and how many pairs each row has."""
    pairs, times = batch.column(batch.schema.get_field_index("pairs")).to_pylist(), batch.column(batch.schema.get_field_index("times")).to_pylist()
    return np.frombuffer(b"".join(pairs), "<u8"), np.frombuffer(b"".join(times), "<u4"), np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a * 2**32 + b), a_id, b_id, n, best: how often each id pair is linked in all texts, and whether no other pair
    with that id of B is linked more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, where = np.unique(np.concatenate([keys, *(k for k, _ in held)]), return_inverse=True)
            held_sums = np.concatenate([sums, *(n for _, n in held)])
            held.clear()
            return every, np.bincount(where, held_sums, len(every)).astype(np.int64)

        for batch in batches:
            pairs, times, _ = _unpacked(batch)
            held.append((pairs, times.astype(np.int64)))
            if sum(len(k) for k, _ in held) >= HELD_PAIRS:
                keys, sums = merged()
                if len(keys) >= HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["pair", "n"])
                    keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["pair", "n"])

    summed = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    scratch = Scratch(aligned.sparkSession)
    table = scratch.written(summed.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), (F.col("pair") % (1 << 32)).cast("int").alias("b_id"), "n"), "pairs")
    most = table.groupBy("b_id").agg(F.max("n").alias("most"))  # as many rows as B has ids
    return table.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _share() -> Column:
    return F.floor(F.log2("n") * 16)


def with_pair_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its pairs, with n_best (links that are the most frequent of their id of B) and count_sum (the
    sum of the counts of its links). ``counts`` comes from ``pair_counts``."""
    taken, least = 0, 0
    for r in counts.groupBy(_share().alias("share")).count().orderBy(F.desc("share")).collect():  # some 16 rows a doubling
        taken += r["count"]
        if taken > frequent:
            least = r["share"] + 1
            break
    known = counts.filter(_share() >= least).select("pair", "n", "best").toArrow()  # at most ``frequent`` rows
    order = np.argsort(known.column("pair").to_numpy())
    names = ("pair", "n", "best")
    table = aligned.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy()[order] for c in names))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    kinds = dict(aligned.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            pairs, times, size = _unpacked(batch)
            pairs, times = pairs.astype(np.int64), times.astype(np.int64)
            at = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1) if len(pair) else np.zeros(len(pairs), np.int64)
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums = [np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)]
            if len(pair):
                sums = [np.where(hit, times * best[at], 0), np.where(hit, times * n[at], 0)]
            rest = np.flatnonzero(~hit)
            bounds = np.concatenate([[0], np.cumsum(size)])
            cut = pa.array(np.searchsorted(rest, bounds).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x[rest])) for x in (pairs, times)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(_row_sums(s, size)) for s in sums), *lists], names=[*kept, "n_best", "count_sum", "rest", "rest_times"])

    looked = aligned.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_best long, count_sum long, rest array<long>, rest_times array<long>")
    if taken <= frequent:
        return looked.drop("rest", "rest_times")
    others = looked.select("row", F.explode(F.arrays_zip(F.col("rest").alias("pair"), F.col("rest_times").alias("times"))).alias("p")).select("row", "p.pair", "p.times")
    found = others.join(counts.filter(_share() < least), "pair")
    more = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = looked.drop("rest", "rest_times").join(more, "row", "left")
    return whole.select(*kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Each text's alignment with the counts of its linked pairs over all texts: tokenised once, the links are written."""
    scratch = Scratch(docs.sparkSession)
    aligned = scratch.written(align_tokens(docs, a_path, b_path, id_col, text_col), "aligned")
    return with_pair_counts(aligned, pair_counts(aligned), frequent)
