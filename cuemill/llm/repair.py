"""Token ids in grammar-compressed files (Re-Pair), with random access by document.

Documents are range-partitioned and sorted by id, encoded, and gathered into shards of some ``SHARD_IDS`` ids. In each shard
the most frequent pairs of neighbouring symbols are replaced by nonterminals, in descending order of frequency (those within
one factor of ``STEP`` in one round, better pairs first where they overlap), until no pair occurs ``LEAST`` times or more: a
rarer pair's rule would take more bits than it saves. Each shard is one row of a Parquet table written by Spark (so a lost
executor or a second attempt leaves no half-written file): its rules, the expansion length of every rule, the compressed
sequence and a directory of documents. A document is decoded from its own symbols alone: replacement never reaches over the
end of a document, and expansion lengths lead to any id without expanding what comes before it.

Payload: seven little-endian u32 ``magic | terminals | rules | symbols | documents | bits of an id | bits of a length``, then
bit-packed little-endian columns, each filled up to a byte: the terminals' ids, rules (left, right), expansion lengths,
symbols, and per document its numbers of symbols and of ids. Symbols below the number of terminals are places in their list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import as_text
from .tokens import encoder

MAGIC = 0x52503032
SHARD_IDS = 1 << 18
LEAST, STEP = 3, 4
SHARD = "part long, shard long, part_start long, n_ids long, doc_ids array<long>, payload binary"
BUCKETS = 1 << 18


def _places(symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places where a pair starts that lies in one document; of a run of one symbol every other, so none overlaps itself."""
    ok = inside[:-1].copy()
    twin = np.flatnonzero(ok & (symbols[1:] == symbols[:-1]))
    if len(twin):
        run = np.ones(len(twin), bool)
        run[1:] = twin[1:] != twin[:-1] + 1
        first = twin[np.maximum.accumulate(np.where(run, np.arange(len(twin)), 0))]
        ok[twin[(twin - first) % 2 == 1]] = False
    return ok


def _often(symbols: np.ndarray, ok: np.ndarray, least: int) -> np.ndarray:
    """Places that hold every pair that occurs ``least`` times or more, and few others."""
    bucket = symbols[:-1] * np.uint32(0x9E3779B1)
    bucket ^= symbols[1:] * np.uint32(0x85EBCA77)
    bucket >>= np.uint32(14)
    bucket[~ok] = BUCKETS
    often = np.bincount(bucket, minlength=BUCKETS + 1) >= least  # a bucket has every occurrence of its pairs
    often[BUCKETS] = False
    return np.flatnonzero(often[bucket])


def _ranked(symbols: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs at these places, which have all occurrences of a pair or none: the places of pairs that occur ``least`` times
    or more, the rank of each by frequency, and the pairs' counts by rank."""
    code = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]
    order = np.argsort(code)
    code = code[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    n = np.diff(np.append(start, len(code)))
    best = np.argsort(-n, kind="stable")[: int((n >= least).sum())]
    rank = np.full(len(n), len(n), np.int32)
    rank[best] = np.arange(len(best), dtype=np.int32)
    each = np.empty(len(code), np.int32)
    each[order] = np.repeat(rank, n)
    kept = each < len(best)
    return at[kept], each[kept], n[best]


def _choose(n: int, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of overlapping occurrences those of better rank (of equal rank the left one); pairs with too few left are dropped."""
    far = np.int32(1 << 30)
    open_ = np.full(n + 2, far, np.int32)  # rank of the undecided occurrence that starts before each place
    open_[at + 1] = rank
    taken = np.zeros(n + 2, bool)
    todo, todo_rank = at, rank
    for _ in range(3):
        wins = (open_[todo] > todo_rank) & (open_[todo + 2] >= todo_rank)
        won = todo[wins]
        taken[won + 1] = True
        open_[won] = open_[won + 1] = open_[won + 2] = far
        todo, todo_rank = todo[~wins], todo_rank[~wins]
        free = ~taken[todo] & ~taken[todo + 2]
        todo, todo_rank = todo[free], todo_rank[free]
        if not len(todo):
            break
    kept = taken[at + 1]
    at, rank = at[kept], rank[kept]
    enough = np.bincount(rank, minlength=1)[rank] >= LEAST
    return at[enough], rank[enough]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them."""
    top = int(values.max(initial=0)) + 1
    if top > 1 << 22:
        distinct, number = np.unique(values, return_inverse=True)
        return distinct, number.astype(np.uint32)
    seen = np.zeros(top, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.uint32) - np.uint32(1))[values]


def compress(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals' ids, rules, expansion lengths, symbols, symbols of each document); a document has one id at least."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    terminals, symbols = _numbered(ids)
    inside = np.ones(len(symbols), bool)  # whether the next symbol is of the same document
    inside[np.cumsum([len(d) for d in docs], dtype=np.int64) - 1] = False
    first = len(terminals)
    rules: list[np.ndarray] = []
    lengths = np.ones(first, np.int64)
    least = LEAST
    while least * STEP <= len(symbols) // 64:
        least *= STEP
    known = None  # places to look at, where the last round had the same threshold
    while len(symbols) > 1:
        ok = _places(symbols, inside)
        at, rank, counts = _ranked(symbols, _often(symbols, ok, least) if known is None else known[ok[known]], least)
        if not len(counts):
            if known is not None:  # a last look at everything
                known = None
                continue
            if least == LEAST:
                break
            least //= STEP
            continue
        places, used = _choose(len(symbols), at, rank)
        if not len(places):  # overlaps leave no pair enough: the best one alone
            places, used = at[rank == 0], rank[rank == 0]
        kept, slot = _numbered(used)
        example = np.empty(len(kept), np.int64)
        example[slot] = places
        pairs = np.stack([symbols[example], symbols[example + 1]], axis=1)
        rules.append(pairs)
        new = len(lengths)
        symbols[places] = (new + slot).astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]]])
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        inside[places] = inside[places + 1]
        if least == LEAST:  # only pairs that were frequent, and those with a new symbol, can be frequent now
            moved = np.cumsum(stays) - 1
            look = np.zeros(int(moved[-1]) + 2, bool)
            look[moved[at[stays[at]]]] = True
            look[moved[places]] = look[moved[places] - 1] = True
            look[-2:] = False
            known = np.flatnonzero(look)
        symbols, inside = symbols[stays], inside[stays]
        least = max(LEAST, least // STEP)
    per_doc = np.diff(np.flatnonzero(~inside), prepend=-1)
    return terminals, np.concatenate([np.zeros((0, 2), np.uint32), *rules]), lengths[first:], symbols, per_doc


def _bits(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack_bits(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def to_payload(docs: list[np.ndarray]) -> bytes:
    terminals, rules, lengths, symbols, per_doc = compress(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    head = [MAGIC, len(terminals), len(rules), len(symbols), len(docs), _bits(terminals.max(initial=0)), _bits(max(sizes.max(initial=0), lengths.max(initial=0)))]
    symbol, size = _bits(len(terminals) + len(rules)), head[-1]
    columns = [(terminals, head[-2]), (rules.ravel(), symbol), (lengths, size), (symbols, symbol), (per_doc, size), (sizes, size)]
    return np.array(head, "<u4").tobytes() + b"".join(pack_bits(v, w) for v, w in columns)


class ShardReader:
    """Random access to the documents of a payload."""

    def __init__(self, payload: bytes):
        magic, n_terminals, n_rules, n_symbols, n_docs, wide, size = np.frombuffer(payload, "<u4", 7).tolist()
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at, columns = np.frombuffer(payload, np.uint8), 28, []
        symbol = _bits(n_terminals + n_rules)
        for n, width in ((n_terminals, wide), (2 * n_rules, symbol), (n_rules, size), (n_symbols, symbol), (n_docs, size), (n_docs, size)):
            columns.append(unpack_bits(raw[at:], n, width))
            at += -(-n * width // 8)
        self.terminals, rules, lengths, self.symbols, per_doc, self.n_ids = columns
        self.first, self.rules = n_terminals, rules.reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(n_terminals, np.int64), lengths])
        self.starts = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)

    def _expand(self, s: np.ndarray) -> np.ndarray:
        """Every symbol goes straight to where its expansion starts; a rule leaves its left part there and sends its right
        part on, so each symbol of the grammar's trees is touched once."""
        size = self.lengths[s]
        place = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<u4")
        while len(s):
            plain = s < self.first
            out[place[plain]] = self.terminals[s[plain]]
            s, place = s[~plain], place[~plain]
            pair = self.rules[s - self.first]
            s, place = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([place, place + self.lengths[pair[:, 0]]])
        return out

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def documents(self) -> list[np.ndarray]:
        """All documents, expanded together."""
        return np.split(self._expand(self.symbols), np.cumsum(self.n_ids.astype(np.int64))[:-1]) if len(self.n_ids) else []

    def token(self, i: int, at: int) -> int:
        """Id number ``at`` of document i: down one path of rules, by their lengths."""
        s = self.symbols[self.starts[i] : self.starts[i + 1]]
        ends = np.cumsum(self.lengths[s])
        k = int(np.searchsorted(ends, at, side="right"))
        at -= int(ends[k] - self.lengths[s[k]])
        symbol = int(s[k])
        while symbol >= self.first:
            left, right = self.rules[symbol - self.first].tolist()
            symbol, at = (left, at) if at < self.lengths[left] else (right, at - int(self.lengths[left]))
        return int(self.terminals[symbol])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Encodes every whole text and writes the shards under ``path`` in ascending id order, replacing what is there.

    A null or empty text is its end id alone. Null ids come first; rows with equal ids follow each other ordered by a
    hash of the text, each as a document of its own. Extra columns are ignored; an empty table gives an empty file set.
    """
    rows = as_text(docs, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, True).stream
        end = end_id.to_bytes(4, "little")
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, held, shard
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            row = [[part], [shard], [before], [held], [doc_ids[:]], [to_payload(ids)]]
            before, shard, held = before + held, shard + 1, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "shard", "part_start", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(encoded + end, "<u4"))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered.mapInArrow(encode, SHARD).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of each document."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row per written partition
    before, seen = {}, 0
    for part in sorted(totals):
        before[part], seen = seen, seen + totals[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, part_start, doc_ids, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                reader = ShardReader(payload)
                n = reader.n_ids.astype(np.int64)
                begin = before[part] + part_start + np.cumsum(n) - n
                ids = [d.astype("<u4", copy=False).tobytes() for d in reader.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begin), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.select("part", "part_start", "doc_ids", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
