"""Comparing the members of groups of any size without a group meeting in one task.

A group of more than ``cap`` members is dealt at random into blocks of about that size, and each two of its
blocks meet in a task of their own. What a task reports is at most as long as what it read: counts and a
spanning forest of the links it found, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block.
CAP = 1024


def in_blocks(rows: DataFrame, keys: list[str], member: str, cap: int = CAP) -> DataFrame:
    """The rows of groups of two and more, once for each task they take part in.

    Adds ``left`` and ``right``, the blocks that meet, and ``block``, the row's own. Rows come sorted by
    keys, left, right.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    parts = F.ceil(F.col("_size") / cap).cast("int")
    dealt = (
        rows.join(sizes, keys)
        .withColumn("_parts", parts)
        .withColumn("block", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("left", F.least("block", "_other"))
        .withColumn("right", F.greatest("block", "_other"))
        .drop("_size", "_parts", "_other")
    )
    by = [*keys, "left", "right"]
    return dealt.repartition(*by).sortWithinPartitions(*by)


def fixed_rows(column: pa.Array, dtype: str | np.dtype = "u1") -> np.ndarray:
    """A binary column whose rows are equally long, as a matrix."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    width = int(offsets[1] - offsets[0]) if len(column) else 0
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])]
    return raw.reshape(len(column), width).view(dtype)


def column_values(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        widths = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1])
        if len(widths) and (widths == widths[0]).all() and widths[0]:
            return fixed_rows(column)
        out = np.empty(len(column), dtype=object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of rows that come sorted by ``keys``, each as a dictionary of arrays."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {name: column_values(batch.column(i)) for i, name in enumerate(batch.schema.names)}
        if held is not None:
            now = {k: _joined(held[k], v) for k, v in now.items()}
        n = len(now[keys[0]])
        change = np.zeros(n - 1, dtype=bool)
        for k in keys:
            change |= now[k][1:] != now[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield {k: v[a:b] for k, v in now.items()}
        held = {k: v[cuts[-1] :] for k, v in now.items()}
    if held is not None:
        yield held


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == b.dtype and a.ndim == b.ndim and a.shape[1:] == b.shape[1:]:
        return np.concatenate([a, b])
    out = np.empty(len(a) + len(b), dtype=object)
    out[:] = [*(x if isinstance(x, bytes) else x.tobytes() for x in a), *(x if isinstance(x, bytes) else x.tobytes() for x in b)]
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n members' component, the links being i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Reports:
    """Rows (a, b, n) of int64 that a task hands on, in batches."""

    SCHEMA = "a long, b long, n long"

    def __init__(self, limit: int = 65_536):
        self.limit, self.rows, self.held = limit, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        if len(a):
            self.rows.append((a, b, n))
            self.held += len(a)

    def batch(self) -> pa.RecordBatch:
        columns = [np.concatenate([r[k] for r in self.rows]).astype(np.int64) if self.rows else np.zeros(0, np.int64) for k in range(3)]
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n"])

    @property
    def full(self) -> bool:
        return self.held >= self.limit
