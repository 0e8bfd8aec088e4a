"""Helpers for operators that read whole texts in Arrow batches inside tasks."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task takes apart at once; a longer text comes alone.
SLICE_BYTES = 4 << 20
#: What this worker keeps from task to task, by step.
_KEPT: dict[str, dict] = {}


def kept(step: str) -> dict:
    """What this worker keeps from one task of a step to the next."""
    return _KEPT.setdefault(step, {})


def let_go(but: str = "") -> None:
    """Drop what this worker keeps for other steps: it serves one step after the other, and each needs the memory."""
    for step in _KEPT.keys() - {but}:
        del _KEPT[step]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, step: str = ""
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most ``limit`` bytes together, or one row; only ``step`` stays kept."""
    let_go(step)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column, NULL as none."""
    return [b"" if x is None else x for x in pc.cast(batch.column(column), pa.binary()).to_pylist()]


def numbered(texts: list[bytes], lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each place, number of words of each text)"""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    find = numbers.__getitem__
    ids, sizes = array("q"), []
    for text in texts:
        own = (text.lower() if lower else text).split()
        ids.extend(map(find, own))
        sizes.append(len(own))
    return list(numbers), np.frombuffer(ids, np.int64), np.array(sizes, np.int64)


def batch_like(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def with_struct(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` as one struct, so that no name can clash with an operator's own columns."""
    return docs.select(F.struct(*docs.columns).alias(name))
