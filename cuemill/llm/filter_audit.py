"""Interaction of five filters: what each removes at every step of every order in which they can run.

A document's failures are a mask of five bits. Which filter removes it first depends only on the mask and the order, so a
table of 32 masks by 120 orders, made once, has the step of the first failure. Tasks count their documents by part, mask and
label, look the masks up in the table, add up removals by order and step, and send one array a part and measure; these
partial arrays are summed by Spark. No document is run through the filters more than once.

Four filters look at the text alone. The fifth, repeats, asks whether any smaller id has the same text: the least id of each
text (by SHA-256) is found by an aggregation, and rows of repeated texts that are not the least move from their mask to
the one with that bit. Only rows of repeated texts are joined, those of very frequent texts by a salted key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import as_text, text_buffer
from .shared import Scratch, salted_join

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose counts a task holds, and parts whose arrays are in one batch.
HELD_PARTS, BATCH_PARTS = 4096, 64
_UPPER, _MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
_TAILS = bytes(range(0x80, 0xC0))  # bytes of a character but its first
PARTIAL = "part string, removed array<long>, redundant array<long>, unique_fails array<long>, good_lost array<long>, toxic_lost array<long>, shapley array<long>, total long"


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, of the first filter of the order that the mask fails; 5 if it fails none."""
    table = np.full((32, len(ORDERS)), 5, np.int64)
    for k, order in enumerate(ORDERS):
        for step in range(4, -1, -1):
            table[(np.arange(32) >> FILTERS.index(order[step]) & 1).astype(bool), k] = step
    return table


FIRST = first_failures()
#: Bit of the filter at each step of each order, and [order, step, mask]: whether the mask fails that filter.
BIT = np.array([[1 << FILTERS.index(c) for c in order] for order in ORDERS])
FAILS = (np.arange(32) & BIT[:, :, None]) > 0


def text_mask(text: bytes) -> int:
    """Bits 1 to 8 for failures of A to D: under 200 words, distinct words under half, over a fiftieth of A-Z, a mark."""
    words = text.split()  # on the blank and on 0x09 to 0x0D
    points = len(text.translate(None, _TAILS))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * points) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _masks(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``names`` of each row, the mask of its text, and the text's digest."""
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    rows = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).select(*names, digest.alias("digest"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(len(names) + 1))
            mask = [text_mask(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mask, pa.int32())], names=[*names, "digest", "mask"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", digest binary, mask int")


def partial_arrays(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Of counts [mask, quality, toxic], each measure as an array [order, step]."""
    every, good, toxic = counts.sum((1, 2)), counts[:, 1, :].sum(1), counts[:, :, 1].sum(1)
    cell = (np.arange(len(ORDERS)) * 6 + FIRST).ravel()

    def removed(n: np.ndarray) -> np.ndarray:
        return np.bincount(cell, np.repeat(n, len(ORDERS)), len(ORDERS) * 6).reshape(-1, 6)[:, :5].astype(np.int64)

    out = {"removed": removed(every), "good_lost": removed(good), "toxic_lost": removed(toxic)}
    out["redundant"] = FAILS @ every - out["removed"]
    out["unique_fails"] = every[BIT]
    by_filter = np.bincount(BIT.ravel(), out["removed"].ravel(), 32).astype(np.int64)
    out["shapley"] = by_filter[BIT]
    return out


def _partials(rows: DataFrame) -> DataFrame:
    """One row of arrays for each part of each task; of rows (part, mask, label, n), n may be negative."""

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        parts = list(held)
        for at in range(0, len(parts), BATCH_PARTS):
            some = parts[at : at + BATCH_PARTS]
            made = [partial_arrays(held[p].reshape(32, 2, 2)) for p in some]
            columns = [pa.array([m[name].ravel().tolist() for m in made], pa.list_(pa.int64())) for name in MEASURES]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *columns, pa.array([int(held[p].sum()) for p in some], pa.int64())], names=["part", *MEASURES, "total"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            cell = coded.indices.to_numpy().astype(np.int64) * 128 + batch.column(1).to_numpy() * 4 + batch.column(2).to_numpy()
            parts = coded.dictionary.to_pylist()
            counts = np.bincount(cell, batch.column(3).to_numpy(), len(parts) * 128).astype(np.int64).reshape(-1, 128)
            for part, n in zip(parts, counts, strict=True):
                held[part] = held[part] + n if part in held else n
                if len(held) >= HELD_PARTS:
                    yield from flush(held)
        yield from flush(held)

    return rows.mapInArrow(run, PARTIAL)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (see the README).

    One row for each part, order and step, zeros included. A null text is empty, a null part is the empty string. A row
    fails the repeat filter if a row of a smaller id has its text; rows of one id do not fail it for each other, and a null
    id is smaller than none and has none smaller. Several labels of one id count as 1 if any is 1; a row without label is
    neither good nor toxic. Extra columns are ignored; an empty table gives no rows, as it has no part.
    """
    scratch = Scratch(docs.sparkSession)
    rows = as_text(docs, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("body"))
    one = lambda name: F.max((F.coalesce(F.col(name), F.lit(0)) == 1).cast("int"))
    label = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((one("quality") * 2 + one("toxic")).alias("label"))
    facts = scratch.written(_masks(rows, "body", ["id", "part"]).join(label, "id", "left").select("id", "part", "digest", "mask", F.coalesce("label", F.lit(0)).alias("label")), "audit-facts")
    repeated = scratch.written(facts.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).filter("most > least").drop("most"), "audit-repeated")
    later = salted_join(facts, repeated, ["digest"], ["id"]).filter("id > least")
    move = F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))).alias("to")
    moved = later.select("part", "label", move).select("part", "to.mask", "label", "to.n")
    partial = _partials(facts.select("part", "mask", "label", F.lit(1).alias("n")).unionByName(moved))
    return _summed(partial)


def _summed(partial: DataFrame) -> DataFrame:
    """The partial arrays of each part added up, one row a cell."""
    zipped = F.posexplode(F.arrays_zip(*MEASURES))  # of 600 cells
    cells = partial.select("part", "total", zipped).groupBy("part", "pos").agg(*[F.sum(f"col.{m}").alias(m) for m in MEASURES], F.sum("total").alias("total"))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("pos") / 5) + 1).cast("int"))
    by_part = cells.select("part", order.alias("filter_order"), (F.col("pos") % 5 + 1).cast("int").alias("step"), *MEASURES, "total")
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return by_part.select("part", "filter_order", "step", (F.col("total") - gone).alias("kept"), *MEASURES)
