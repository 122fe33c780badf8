"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is a bag of words; its margin is the largest margin of a word. Words are compared by a gap-weighted subsequence
kernel: all runs of ``ORDER`` = 3 letters in order, not necessarily next to each other, that span at most ``SPAN``
letters, weighted by ``DECAY`` per skipped letter, normalised by length. So an insult with gaps or inserted characters
stays near the plain one, and unseen inflections near their stem. Letters spelled apart ("i d i o t", "i.d.i.o.t") are
joined first, and a long word is read in overlapping pieces of ``PIECE`` letters.

Training is multiple-instance: each toxic text must have a word on the positive side, chosen again after every round
from words that toxic texts have far more often, and no word of a clean text may lie there; clean words that score
highest are added. Near copies in the sample count once. The kernel is approximated by
``landmarks`` words (K_mm^-1/2 maps a word to a vector), a linear machine is fitted on those vectors, and its dual form
over subsequences is what scores words. A logistic curve over text margins gives scores between 0 and 1. All this uses
a sample of at most ``max_docs`` labelled texts; scoring reads every text whole, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_column, as_text, blocks, text_buffer
from .shared import written
from .wordscan import NOT_SPACE, scan

SPAN, DECAY, PIECE, STEP = 6, 0.4, 24, 8
MEMO_WORDS = 100_000
#: Least log odds ratio, toxic to clean, of a word that may be what makes a text toxic.
LEAST_ODDS = 2.5
_APART = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,3}){3,}[^\W\d_](?!\w)")
_NOT_LETTER = re.compile(r"[\W_]+")
_LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_WEIGHTS = DECAY ** np.arange(4.0)
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def words_of(text: str | None) -> set[str]:
    """The distinct space-separated words of a text in lower case, letters spelled apart joined."""
    if not text:
        return set()
    text = text.lower()
    return {*text.split(), *(_NOT_LETTER.sub("", m) for m in _APART.findall(text))}


def _pieces(word: str) -> list[str]:
    if not word.isalpha():
        plain = _NOT_LETTER.sub("", word)
        word = _NOT_LETTER.sub("", word if plain.isalpha() else word.translate(_LOOKALIKE))
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE + STEP, STEP)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word (at most ``PIECE`` letters, ends marked) its subsequences: ids and normalised weights in a row, and which
    cells are in use; equal subsequences of a word are summed into one cell."""
    raw = "".join(f"\x02{w[:PIECE]}\x03".ljust(PIECE + 2, "\0") for w in words)
    codes = np.minimum(np.frombuffer(raw.encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64), 0xFFFFF)
    codes = codes[:, : max(3, int((codes > 0).sum(axis=1).max(initial=0)))]
    width = codes.shape[1]
    keys = []
    for i, j in _OFFSETS:
        if j < width:
            a, b, c = codes[:, : width - j], codes[:, i : width - j + i], codes[:, j:]
            keys.append(np.where(c > 0, (a << 42) | (b << 22) | (c << 2) | (j - 2), 0))  # the skipped letters in the last two bits
    key = np.sort(np.concatenate(keys, axis=1), axis=1)
    weight = _WEIGHTS[key & 3] * (key > 0)
    key >>= 2
    first = np.ones(key.shape, bool)
    first[:, 1:] = key[:, 1:] != key[:, :-1]
    place = np.flatnonzero(first.ravel())
    if len(place) < key.size:
        total = np.add.reduceat(weight.ravel(), place)
        weight = np.zeros(key.size)
        weight[place] = total
        weight = weight.reshape(key.shape)
    norm = np.sqrt((weight**2).sum(axis=1, keepdims=True))
    return key, weight / np.where(norm > 0, norm, 1), first & (key > 0)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel values of each word of ``a`` with each of ``b``."""
    kb, wb, ub = subsequences(b)
    ids, slot = np.unique(kb[ub], return_inverse=True)
    table = np.zeros((len(ids) + 1, len(b)))
    np.add.at(table, (slot, np.nonzero(ub)[0]), wb[ub])
    out = np.zeros((len(a), len(b)))
    for start in range(0, len(a), 500):
        ka, wa, ua = subsequences(a[start : start + 500])
        at = np.minimum(np.searchsorted(ids, ka), max(len(ids) - 1, 0))
        hit = ua & (ids[at] == ka) if len(ids) else np.zeros(ka.shape, bool)
        row, col = np.nonzero(hit)
        np.add.at(out, start + row, wa[row, col][:, None] * table[at[row, col]])
    return out


def _copy_key(texts: pa.Array) -> np.ndarray:
    """The least hash of the word triples of each text, which near copies mostly share."""
    raw, offsets = text_buffer(texts)
    out = np.empty(len(offsets) - 1, np.int64)
    for a, b in blocks(offsets):
        words = scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1], NOT_SPACE, lower=True)
        starts, hashes = words.grams(3)
        first = np.searchsorted(starts, words.rows[:-1])
        least = np.minimum.reduceat(np.append(hashes, np.uint64(0)), first) if len(first) else np.zeros(0, np.uint64)
        short = np.searchsorted(starts, words.rows[1:]) == first
        least[short] = words.spans(words.rows[:-1], words.rows[1:])[short]
        out[a:b] = least.view(np.int64)
    return out


@dataclass
class Machine:
    """Margin of a word: sum over its subsequences of ``weights`` plus ``bias``; score: logistic of slope * margin + shift."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = -20.0
    memo: dict[str, float] = field(default_factory=dict)

    def word_margins(self, words: list[str]) -> np.ndarray:
        cut = [_pieces(w) for w in words]
        pieces = [p for c in cut for p in c]
        owner = np.repeat(np.arange(len(words)), [len(c) for c in cut])
        order = np.argsort([len(p) for p in pieces], kind="stable")  # words of one length in a block: no wasted cells
        value = np.full(len(pieces), self.bias)
        for a in range(0, len(pieces), 2000):
            rows = order[a : a + 2000]
            key, weight, used = subsequences([pieces[i] for i in rows.tolist()])
            if len(self.ids):
                at = np.minimum(np.searchsorted(self.ids, key), len(self.ids) - 1)
                value[rows] += (np.where(used & (self.ids[at] == key), self.weights[at], 0.0) * weight).sum(axis=1)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, value)
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def text_margins(machine: Machine, texts: list[str | None]) -> np.ndarray:
    """Largest word margin of each text; one without words has the margin of an empty word."""
    memo, bags = machine.memo, [words_of(t) for t in texts]
    new = sorted(set().union(*bags, {""}).difference(memo))
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = sorted(set().union(*bags, {""}))
    memo.update(zip(new, machine.word_margins(new).tolist(), strict=True))
    return np.array([max(map(memo.__getitem__, b)) if b else memo[""] for b in bags])


def _margins_of(shared, column: pa.Array) -> np.ndarray:
    _, offsets = text_buffer(column)
    machine = shared.value
    parts = [text_margins(machine, column.slice(a, b - a).to_pylist()) for a, b in blocks(offsets, 4 << 20)]
    return np.concatenate([np.zeros(0), *parts])


def with_margin(docs: DataFrame, machine: Machine, text_col: str = "text", margin_col: str = "margin") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most some 100 subsequences a landmark
    return append_column(as_text(docs, text_col), margin_col, T.DoubleType(), lambda batch: pa.array(_margins_of(shared, batch.column(batch.schema.get_field_index(text_col)))))


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last coefficient is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], c * weight[active]
        new = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), xa.T @ (ca * y[active]))
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w


def _fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with smoothed targets (Platt)."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([2.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w), -2, 2)
    return float(w[0]), float(w[1])


def _landmark_machine(positive: dict[str, int], negative: dict[str, int], hard: list[str], landmarks: int) -> Machine:
    """A machine that tells the words in ``positive`` from those in ``negative``, each weighted by its count of texts."""
    marks = sorted({*list(positive)[: landmarks // 2], *hard[: landmarks // 4], *list(negative)[: landmarks // 4]})
    value, vector = np.linalg.eigh(kernel(marks, marks))
    keep = value > 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])
    x = kernel([*positive, *negative], marks) @ root
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    count = np.sqrt(np.array([*positive.values(), *negative.values()], float))
    w = _fit_linear(x, y, count)
    key, weight, used = subsequences(marks)
    ids, slot = np.unique(key[used], return_inverse=True)
    total = np.zeros(len(ids))
    np.add.at(total, slot, (weight * (root @ w[:-1])[:, None])[used])
    return Machine(ids, total, float(w[-1]))


def train_machine(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 12_000, landmarks: int = 400, negatives: int = 4000, candidates: int = 30, rounds: int = 4
) -> Machine:
    """A machine from the labelled texts whose ids satisfy ``usable``, at most ``max_docs`` of them, chosen by hash.

    Rows without id or with another label than 0 or 1 are left out. Without a toxic or without a clean text the machine
    scores every text near 0.
    """
    picked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    picked = (picked if usable is None else picked.filter(usable)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id", "label").limit(max_docs)  # max_docs short rows: the proven bound of the broadcast
    rows = as_text(docs, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("text", "label")
    sample = written(append_column(rows, "copy", T.LongType(), lambda batch: pa.array(_copy_key(batch.column(0)))), "toxicity-sample")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([sorted({p for w in words_of(t) for p in _pieces(w) if len(p) > 2}) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["label", "copy", "words"])

    bag = written(sample.mapInArrow(bags, "label int, copy long, words array<string>").dropDuplicates(["label", "copy"]), "toxicity-bags")
    counts = {r["label"]: r["count"] for r in bag.groupBy("label").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Machine(np.zeros(0, np.int64), np.zeros(0))
    vocabulary = written(bag.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")), "toxicity-words")
    odds = F.log((F.col("pos") + 0.5) / (counts[1] + 1)) - F.log((F.col("neg") + 0.5) / (counts[0] + 1))
    vocabulary = vocabulary.withColumn("odds", odds).withColumn("tell", F.col("pos") * odds)
    telling = vocabulary.filter(f"pos > 0 and odds >= {LEAST_ODDS}").select("word", "tell")
    best = bag.filter("label = 1").select("copy", F.explode("words").alias("word")).join(telling, "word").groupBy("copy").agg(F.slice(F.sort_array(F.collect_list(F.struct("tell", "word")), asc=False), 1, candidates).alias("best"))
    toxic = [[w["word"] for w in r["best"]] for r in best.orderBy("copy").collect()]  # at most max_docs lists of ``candidates`` words
    telling_rows = vocabulary.filter(f"pos >= {3 if counts[1] >= 30 else 2} and odds >= {LEAST_ODDS}").orderBy(F.desc("tell"), "word").limit(landmarks * 4).collect()
    clean = vocabulary.filter(f"neg > 0 and odds < {LEAST_ODDS / 2}").select("word", "neg")
    negative = {r["word"]: r["neg"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(negatives).collect() + clean.orderBy(F.desc("neg"), "word").limit(negatives // 4).collect()}
    telling_words = {r["word"]: r["pos"] for r in telling_rows} or {t[0]: 1 for t in toxic if t}
    if not telling_words or not negative:
        return Machine(np.zeros(0, np.int64), np.zeros(0))
    positive, hard = telling_words, []
    for k in range(rounds):
        machine = _landmark_machine(positive, negative, hard, landmarks)
        if k < rounds - 1:
            every = sorted({w for t in toxic for w in t})
            value = dict(zip(every, machine.word_margins(every).tolist(), strict=True))
            witness = {max(t, key=lambda w: (value[w], w)) for t in toxic if t}
            positive = telling_words | {w: 1 for w in sorted(witness) if value[w] > 0 and w not in telling_words}
            found = with_margin(clean, machine, "word").orderBy(F.desc("margin"), F.desc("neg"), "word").limit(negatives // 4).collect()
            found = {r["word"]: r["neg"] for r in found if r["margin"] > -1}
            hard, negative = list(dict.fromkeys([*found, *hard])), negative | found
    fitted = with_margin(sample, machine).select("margin", "label").collect()  # at most max_docs rows
    machine.slope, machine.shift = _fit_curve(np.array([r["margin"] for r in fitted]), np.array([r["label"] for r in fitted], float))
    return machine


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``score_col``.

    Each row is scored alone from its whole text: repeated rows score the same, a null or empty text as one without words.
    An empty table gives an empty table. Other columns pass through; one already called ``score_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(shared.value.scores(_margins_of(shared, batch.column(batch.schema.get_field_index(text_col)))))

    return append_column(as_text(docs, text_col), score_col, T.DoubleType(), score)
