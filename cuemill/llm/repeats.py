"""Removal of passages that occur more than once, by suffix automata of reference shards.

The reference is the corpus itself, so its automata cannot all be broadcast: they would grow with the data, and every
document would have to meet every shard. Instead shards and documents are brought together by content. The least hashed
``ANCHOR``-word run of a window (its anchor) is the same wherever the window occurs. Runs of windows with one anchor are
a stretch; stretches whose anchor occurs once anywhere cannot hold a repeated window and go no further. The distinct
stretches of all other anchors, each weighted by how often it occurs, are the reference. They are dealt to shards of about
``max_words`` words by anchor, a suffix automaton with occurrence counts is built of each shard, and the shard's stretches
are streamed through it for matching statistics: a window is repeated where the longest suffix that occurs twice has its
length.

An anchor with more than ``max_contexts`` distinct stretches (a frequent line) would make a shard too large. Its stretches are
cut again by a longer anchor, up to the window itself, which has one context only; pieces whose longer anchor occurs once go no
further, and the others come to shards of their own. So every repeated window is found by an automaton, and no task holds
more than a bounded shard.

Equal stretches are those with two equal 64-bit hashes (``Words.identity``, or two hashes of the word hashes) and equal
lengths. Frequent anchors and stretches are salted where they are joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import as_text, blocks, release, text_buffer
from .automaton import SuffixAutomaton
from .shared import Scratch, new_table_path, salted_join, written
from .wordscan import NOT_SPACE, Words, mix, run_hashes, scan

ANCHOR = 9
STRETCH = ["m", "s", "t"]  # anchor and both hashes of the words
#: Places are word number * 64 + windows in the stretch.
FOUND = "m long, s long, t long, row long, place long"
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def stretches(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, both content hashes, first word and number of windows of every stretch."""
    starts = words.gram_starts(window)
    if not len(starts):
        return (*[np.zeros(0, np.uint64)] * 3, *[np.zeros(0, np.int64)] * 2)
    k = min(ANCHOR, window)
    at, hashes = words.grams(k)
    order = np.full(len(words.hashes), np.uint64(2**64 - 1))
    order[at] = mix(hashes)
    anchor = np.empty(len(starts), np.int64)
    view = sliding_window_view(order, window - k + 1)
    for a in range(0, len(starts), 1 << 16):
        anchor[a : a + (1 << 16)] = view[starts[a : a + (1 << 16)]].argmin(axis=1) + starts[a : a + (1 << 16)]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    return order[anchor[first]], *words.identity(starts[first], starts[first] + n + window - 1), starts[first], n


def _scan_blocks(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = text_buffer(column)
    for a, b in blocks(offsets, size):
        yield a, b, scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1], NOT_SPACE)


def _find_stretches(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, words in _scan_blocks(batch.column(1)):
                *hashes, first, n = stretches(words, window)
                row = np.searchsorted(words.rows, first, side="right") - 1
                place = (first - words.rows[row]) * 64 + n - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(h.view(np.int64) for h in hashes), ids[a + row], place)], names=[*STRETCH, "row", "place"])

    return rows.select("row", text_col).mapInArrow(find, FOUND)


def _contents(distinct: DataFrame, rows: DataFrame, text_col: str, window: int) -> DataFrame:
    """(m, s, t, n, words): the word hashes of one occurrence of each distinct stretch."""
    wanted = distinct.select(F.col("one.row").alias("row"), F.struct(*STRETCH, "n", F.col("one.place").alias("place")).alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    met = rows.select("row", text_col).join(wanted, "row")  # both by row number: the list holds places of that text only
    names = [*STRETCH, "n"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fields = {f.name: column for f, column in zip(lists.type.value_type, lists.flatten().flatten(), strict=True)}
            place = fields["place"].to_numpy()
            for a, b, words in _scan_blocks(batch.column(0)):
                x, y = int(bounds[a]), int(bounds[b])
                row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                size = place[x:y] % 64 + window
                ends = np.cumsum(size)
                at = words.rows[row] + place[x:y] // 64
                taken = words.hashes[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if y > x else 0)]
                edges = np.concatenate([[0], ends * 8]).astype(np.int32)
                spelled = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(edges), pa.py_buffer(taken)])
                yield pa.RecordBatch.from_arrays([*(fields[c].slice(x, y - x) for c in names), spelled], names=[*names, "words"])
        release()

    return met.select(text_col, "wanted").mapInArrow(extract, "m long, s long, t long, n long, words binary")


def shard_masks(contents: DataFrame, window: int, n_shards: int) -> DataFrame:
    """(m, s, t, n, mask): bit i is set where window i of the stretch occurs at least twice, by a suffix automaton per shard."""
    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(n_shards)).cast("int")).repartition(n_shards, "shard").sortWithinPartitions("shard")

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        rows = [(*key, n, np.frombuffer(words, np.int64).tolist()) for *key, n, words in rows]
        for *_, n, words in rows:
            automaton.add(words, n)
        automaton.finish()
        masks = [sum(1 << i for i, length in enumerate(automaton.repeated(words)[window - 1 :]) if length >= window) for *_, words in rows]
        masks = np.array(masks, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array(masks)], names=[*STRETCH, "n", "mask"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for shard, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and shard != current:
                    yield settle(held)
                    held = []
                current = shard
                held.append(tuple(row))
        if held:
            yield settle(held)
        release()

    return dealt.select("shard", *STRETCH, "n", "words").mapInArrow(build, "m long, s long, t long, n long, mask long")


def _sizes(column: pa.Array) -> np.ndarray:
    """Words in each value of a column of word hashes."""
    return pc.binary_length(column).to_numpy().astype(np.int64) // 8


def _cut_by_anchor(contents: DataFrame, window: int, run: int) -> DataFrame:
    """(m, s, t, first, m2, n, words): the stretches of ``contents`` cut into runs of windows with one anchor of ``run`` words;
    ``first`` is the first window's number in the stretch."""
    names = [*STRETCH, "first", "m2", "n", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64)
            ends = np.cumsum(_sizes(batch.column(4)))
            begins = np.concatenate([[0], ends[:-1]])
            row = np.repeat(np.arange(batch.num_rows), ends - begins)
            at = np.arange(len(flat))
            starts = at[at + window <= ends[row]]
            hashes = np.full(len(flat), np.uint64(2**64 - 1))
            inner = at[at + run <= ends[row]]
            hashes[inner] = run_hashes(flat, inner, inner + run)
            view = sliding_window_view(hashes, window - run + 1)
            anchor = np.empty(len(starts), np.int64)
            for x in range(0, len(starts), 1 << 16):
                anchor[x : x + (1 << 16)] = view[starts[x : x + (1 << 16)]].argmin(axis=1) + starts[x : x + (1 << 16)]
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(starts)))
            home, begin = row[starts[first]], starts[first]
            words = pa.array([flat[p : p + c + window - 1].tobytes() for p, c in zip(begin.tolist(), count.tolist(), strict=True)], pa.binary())
            parents = [batch.column(i).take(pa.array(home)) for i in range(4)]
            columns = [*parents[:3], pa.array(begin - begins[home]), pa.array(hashes[anchor[first]].view(np.int64)), parents[3], words]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return contents.select(*STRETCH, "n", "words").mapInArrow(cut, "m long, s long, t long, first long, m2 long, n long, words binary")


def masks_of(contents: DataFrame, window: int, max_words: int, max_contexts: int, scratch: Scratch, runs: list[int]) -> DataFrame:
    """(m, s, t, mask) of the stretches of ``contents`` that have a repeated window. Anchors with too many contexts are cut by
    anchors of the first of ``runs``, then of the others."""
    contexts = contents.groupBy("m").agg(F.count(F.lit(1)).alias("contexts"))
    frequent = scratch.written(contexts.filter(F.col("contexts") > max_contexts).select("m"), "repeats-frequent")
    plain = contents.join(frequent, "m", "left_anti")
    total = plain.agg(F.sum(F.length("words")) / 8).first()[0] or 0
    masks = shard_masks(plain, window, max(1, int(-(-total // max_words)))).filter("mask <> 0").select(*STRETCH, "mask")
    if frequent.isEmpty():
        return scratch.written(masks, "repeats-masks")
    pieces = scratch.written(_cut_by_anchor(contents.join(frequent, "m", "left_semi"), window, runs[0]), "repeats-pieces")
    parents = {"pm": F.col("m"), "ps": F.col("s"), "pt": F.col("t"), "m": F.col("m2"), "s": F.xxhash64("words"), "t": F.xxhash64(F.lit(ANCHOR), "words")}
    pieces = pieces.select(*[c.alias(k) for k, c in parents.items()], "first", "n", "words")
    distinct = pieces.groupBy(*STRETCH).agg(F.sum("n").alias("n"), F.min("words").alias("words"))
    often = pieces.groupBy("m").agg(F.sum("n").alias("total")).filter("total > 1").select("m")
    deeper = masks_of(scratch.written(distinct.join(often, "m", "left_semi"), "repeats-contents"), window, max_words, max_contexts, scratch, runs[1:] or runs)
    back = pieces.drop("n", "words").join(deeper, STRETCH).withColumn("mask", F.expr("shiftleft(mask, cast(first as int))"))
    found = back.groupBy(F.col("pm").alias("m"), F.col("ps").alias("s"), F.col("pt").alias("t")).agg(F.bit_or("mask").alias("mask"))
    return scratch.written(masks.unionByName(found), "repeats-masks")


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, d: the struct of all columns): the rows under a stable number each, in files bucketed by it, so that joins by
    row move no text. The catalogue knows the table only while the plan is made."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cuemill_rows_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    rows.repartition(n, "row").write.bucketBy(n, "row").option("path", new_table_path(spark, "rows")).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, result_col: str = "repeats", max_words: int = 50_000, max_contexts: int = 1000) -> DataFrame:
    """``docs`` with a struct column ``result_col``: n_words, n_removed and kept (the words left, joined by one space).

    A word is removed if a window of ``window`` (at most 64) words that covers it, all of one text, also starts anywhere
    else in the input, the same text included. Of repeated rows every one loses its windows. A null, empty or shorter text
    has no window; without words kept is empty. Empty tables give empty tables. Other columns, whatever their names, pass
    through; one already called ``result_col`` is replaced.
    """
    if not 1 <= window <= 64:
        raise ValueError("window must be 1 to 64 words")
    scratch = Scratch(docs.sparkSession)
    rows = _numbered(as_text(docs, text_col).drop(result_col))
    kept = rows.schema["d"].dataType.fields
    texts = rows.select("row", F.col("d")[text_col].alias("text"))
    found = _find_stretches(texts, "text", window)
    anchors = scratch.written(found.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1"), "repeats-anchors")
    met = scratch.written(salted_join(found, anchors, ["m"], ["row", "place"]), "repeats-met")

    distinct = met.groupBy(*STRETCH).agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"))
    contents = scratch.written(_contents(distinct, texts, "text", window), "repeats-contents")
    runs = [k for k in (2 * ANCHOR, 3 * ANCHOR) if k < window] + [window]
    masks = masks_of(contents, window, max_words, max_contexts, scratch, runs)
    counted = masks.join(contents.select(*STRETCH, "n"), STRETCH)
    settled = salted_join(met.select(*STRETCH, "row", "place"), counted, STRETCH, ["row", "place"]).select("row", "place", "mask")
    spots = written(settled.groupBy("row").agg(F.collect_list(F.struct("place", "mask")).alias("spots")), "repeats-spots")
    scratch.clear()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, spots = batch.column(0), batch.column(1).to_pylist()
            columns = d.flatten()
            out = []
            for a, b, words in _scan_blocks(columns[[f.name for f in kept].index(text_col)]):
                for i in range(a, b):
                    lo, hi = words.rows[i - a], words.rows[i - a + 1]
                    edge = np.zeros(hi - lo + 1, np.int32)
                    for p in spots[i] or ():
                        at, mask = p["place"] // 64, p["mask"]
                        on = [at + j for j in range(p["place"] % 64 + 1) if mask >> j & 1]
                        np.add.at(edge, on, 1)
                        np.add.at(edge, [x + window for x in on], -1)
                    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0) + lo
                    out.append({"n_words": int(hi - lo), "n_removed": int(hi - lo - len(left)), "kept": b" ".join([words.word(j) for j in left.tolist()]).decode("utf-8")})
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _ARROW)], names=[*(f.name for f in kept), result_col])

    return rows.join(spots, "row", "left").select("d", "spots").mapInArrow(cut, T.StructType([*kept, T.StructField(result_col, RESULT)]))
