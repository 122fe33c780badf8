"""Arrow helpers shared by the operators that work on record batches inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def as_text(docs: DataFrame, text_col: str) -> DataFrame:
    """The same rows with the text column as a plain string column."""
    if dict(docs.dtypes).get(text_col) == "string":
        return docs
    return docs.withColumn(text_col, F.col(text_col).cast("string"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text stands alone and stays whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def release() -> None:
    """Gives memory that a finished task has freed back to the system: workers stay, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def append_column(docs: DataFrame, name: str, kind: T.DataType, compute: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``docs`` with one more column made batch by batch; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, kind, True)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), compute(batch)], names=[*names, name])
        release()

    return docs.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by the integer columns ``keys``, tables of whole groups with the places where groups start and end."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = _group_starts(table, keys)
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for key in keys:
        value = table.column(key).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(new)
