"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark window (``window`` consecutive words; a shorter item is one window) is a set of word shingles. Shingles
are ordered by how rarely they occur in the corpus. Only an exact copy of the whole window counts, so of an ordered
window its rarest shingle is the whole necessary prefix: a document that lacks it cannot hold the window. Documents are
joined on that shingle, the place of the shingle in the window bounds where the window must start (position) and end
(length), and the words themselves are compared over the item-sized window.

The index of windows is broadcast in blocks of at most ``max_words`` words, its checked size bound. A benchmark of one
block takes one pass. A larger one takes a job a block: each writes what it found by row, its broadcast is given up before the
next is made, and the findings are merged by row; so no task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_column, as_text, blocks, text_buffer
from .shared import free_name, written
from .wordscan import ALPHANUMERIC, Words, hash_run, hash_words, scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Distinct windows (``words``) with the ids of the items that have them (``items``, as strings).

    An item without words, without text or without an id has no window; repeated items and ids merge.
    """
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = items.select(F.col(item_col).cast("string").alias("item"), words.alias("w")).filter("item is not null and size(w) > 0")
    n = F.greatest(F.size("w") - window + 1, F.lit(1))
    starts = F.sequence(F.lit(1), n)
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass
class WindowIndex:
    """One block of windows, as flat arrays; ``prefix`` has, for each shingle length, the sorted prefix shingles and where
    they lead."""

    spelled: bytes = b""  # the words of all windows, joined by blanks in each
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    names: list[str] = field(default_factory=list)  # distinct item ids
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # places in ``names``, window by window
    item_bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shingles: dict[int, np.ndarray] = field(default_factory=dict)
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.items[self.item_bounds[window] : self.item_bounds[window + 1]]]


def _window_shingles(words: list[str], k: int) -> np.ndarray:
    h = hash_words(words)
    k = min(k, len(h))
    return np.array([hash_run(h[i : i + k]) for i in range(len(h) - k + 1)], np.uint64)


def _member(values: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the values found among the keys, and the place of each there; a bit table by the top bits skips most."""
    table = np.zeros(1 << 20, bool)
    table[(sorted_keys >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values >> np.uint64(44)).astype(np.int64)])
    place = np.searchsorted(sorted_keys, values[maybe])
    place[place == len(sorted_keys)] = 0
    same = sorted_keys[place] == values[maybe]
    return maybe[same], place[same]


def _words_of(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    for a, b in blocks(offsets):
        yield a, b, scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1], ALPHANUMERIC, lower=True)


def _rarity(docs: DataFrame, text_col: str, index: WindowIndex) -> dict[int, int]:
    """How often each shingle of the index occurs in the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(index.shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(keys), np.int64) for k, keys in shared.value.items()}
        for batch in batches:
            for _, _, words in _words_of(batch, text_col):
                for k, keys in shared.value.items():
                    _, place = _member(words.grams(k)[1], keys)
                    totals[k] += np.bincount(place, minlength=len(keys))
        for k, keys in shared.value.items():
            seen = totals[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(totals[k][seen])], names=["shingle", "n"])

    counted = docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in counted.collect()}  # one row a shingle of the bounded block


def _build(rows: list, shingle: int) -> WindowIndex:
    index = WindowIndex()
    keys: dict[int, set[int]] = {}
    for r in rows:
        keys.setdefault(min(shingle, len(r["words"])), set()).update(int(x) for x in _window_shingles(r["words"], shingle))
    index.shingles = {k: np.array(sorted(v), np.uint64) for k, v in keys.items()}
    spelled = [" ".join(r["words"]).encode("utf-8") for r in rows]
    index.spelled, index.bounds = b"".join(spelled), np.concatenate([[0], np.cumsum([len(x) for x in spelled], dtype=np.int64)])
    index.names = sorted({i for r in rows for i in r["items"]})
    number = {name: i for i, name in enumerate(index.names)}
    index.items = np.array([number[i] for r in rows for i in r["items"]], np.int32)
    index.item_bounds = np.concatenate([[0], np.cumsum([len(r["items"]) for r in rows], dtype=np.int64)])
    index.hashes = np.array([hash_run(hash_words(r["words"])) for r in rows], np.uint64)
    index.lengths = np.array([len(r["words"]) for r in rows], np.int64)
    return index


def _choose_prefixes(index: WindowIndex, rows: list, rarity: dict[int, int], shingle: int) -> None:
    """The rarest shingle of each window, ties by hash then place."""
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for i, r in enumerate(rows):
        best = min((rarity.get(int(h), 0), int(h), at) for at, h in enumerate(_window_shingles(r["words"], shingle)))
        if best[0]:  # a shingle that no document has cannot be met
            chosen.setdefault(min(shingle, len(r["words"])), []).append((best[1], i, best[2]))
    for k, found in chosen.items():
        found.sort()
        h = np.array([r[0] for r in found], np.uint64)
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        index.prefix[k] = (keys, np.stack([first, n]), np.array([r[1] for r in found]), np.array([r[2] for r in found]))


def _match(words: Words, index: WindowIndex) -> list[tuple[int, int]]:
    """(word index, window) of every exact occurrence."""
    found = []
    ends = words.row_end()
    row_start = np.repeat(words.rows[:-1], words.counts)
    for k, (keys, groups, windows, offsets) in index.prefix.items():
        starts, hashes = words.grams(k)
        hit, place = _member(hashes, keys)
        first, n = groups[0][place], groups[1][place]
        at = np.repeat(starts[hit], n)
        entry = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = windows[entry]
        begin = at - offsets[entry]
        fits = (begin >= row_start[at]) & (begin + index.lengths[window] <= ends[at])
        begin, window = begin[fits], window[fits]
        same = words.spans(begin, begin + index.lengths[window]) == index.hashes[window]
        for b, w in zip(begin[same].tolist(), window[same].tolist(), strict=True):
            if b" ".join(words.word(b + j) for j in range(index.lengths[w])) == index.spelled[index.bounds[w] : index.bounds[w + 1]]:
                found.append((b, w))
    return found


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, max_words: int = 2_000_000, result_col: str = "contamination"
) -> DataFrame:
    """``docs`` with a struct column ``result_col``: n_words, n_hit, spans (word ranges, end exclusive) and items (sorted).

    Rows are judged one by one, so repeated rows and repeated or null ids each get their own result; with one block no
    shuffle is needed whatever the skew, with more the findings and the rows meet by row. A null text has no words. Empty tables give no rows (documents) or no hits (benchmark).
    Other columns pass through; one that is already called ``result_col`` is replaced. Texts are read whole.
    """
    docs = as_text(docs, text_col)
    windows = benchmark_windows(items, item_col, item_text_col, window)
    n_blocks = max(1, -(-(windows.agg(F.sum(F.size("words"))).first()[0] or 0) // max_words))
    if n_blocks == 1:
        return append_column(docs, result_col, FOUND, _finder(_block(docs, text_col, windows, shingle), text_col))
    windows = written(windows, "benchmark-windows")
    row, kept = free_name(docs, "row"), [F.col(f"`{c}`") for c in docs.columns if c != result_col]
    texts = written(docs.select(*kept, F.monotonically_increasing_id().alias(row)), "benchmark-texts")
    found = None
    for block in range(n_blocks):
        shared = _block(texts, text_col, windows.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == block), shingle)
        each = append_column(texts.select(text_col, row), "__found", FOUND, _finder(shared, text_col)).select(F.col(row).alias("__row"), "__found.*")
        each = written(each if block == 0 else each.filter("n_hit > 0"), "benchmark-found")
        shared.destroy()
        found = each if found is None else found.unionByName(each)
    flat = lambda name: F.flatten(F.collect_list(name))  # noqa: E731  # at most n_blocks lists a row
    merged = found.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_sort(flat("spans")).alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    joined = F.aggregate("spans", F.array().cast("array<array<bigint>>"), _with_span)
    merged = written(merged.withColumn("spans", joined), "benchmark-merged")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    merged = merged.select("__row", F.struct("n_words", n_hit.alias("n_hit"), "spans", "items").alias(result_col))
    return texts.join(merged, texts[row] == merged["__row"]).select(*kept, result_col)


def _with_span(spans: Column, span: Column) -> Column:
    """Disjoint spans in order with one more that starts no earlier than the last of them."""
    last = F.element_at(spans, -1)
    longer = F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
    return F.when((F.size(spans) > 0) & (span[0] <= F.try_element_at(spans, F.lit(-1))[1]), longer).otherwise(F.concat(spans, F.array(span)))


def _block(docs: DataFrame, text_col: str, windows: DataFrame, shingle: int):
    """The broadcast index of some windows, at most about ``max_words`` words of them."""
    rows = windows.collect()
    index = _build(rows, shingle)
    if rows:
        _choose_prefixes(index, rows, _rarity(docs, text_col, index), shingle)
    index.shingles = {}
    return docs.sparkSession.sparkContext.broadcast(index)


def _finder(shared, text_col: str):
    def find(batch: pa.RecordBatch) -> pa.Array:
        index: WindowIndex = shared.value
        out = []
        for _, _, words in _words_of(batch, text_col):
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            rows = words.rows
            for begin, w in _match(words, index):
                row = int(np.searchsorted(rows, begin, side="right")) - 1
                spans.setdefault(row, []).append((begin - int(rows[row]), begin - int(rows[row]) + int(index.lengths[w])))
                items.setdefault(row, set()).update(index.items_of(w))
            for row, n in enumerate(words.counts.tolist()):
                merged = _merge(spans.get(row, []))
                out.append({"n_words": n, "n_hit": sum(y - x for x, y in merged), "spans": merged, "items": sorted(items.get(row, ()))})
        return pa.array(out, _ARROW)

    return find


def is_contaminated(result_col: str = "contamination") -> Column:
    """The rule: words in occurring windows are at least a twentieth of all words."""
    c = F.col(result_col)
    return (c["n_hit"] > 0) & (c["n_hit"] * 20 >= c["n_words"])
