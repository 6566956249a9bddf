"""What the vector operators share: which vectors count, and keys of equal ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INFINITY = float("inf")


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _INFINITY))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vec (array<double>) and the 128-bit key (a, b) of its content, of
    the usable rows."""
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    return out.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64(F.lit("second"), "vec")})


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_key(keys: Sequence[str], handle: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function for rows sorted by ``keys``: ``handle`` gets the
    batches of one key after the other, cut where a key changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            told = np.stack([b.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((told[:, 1:] != told[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = told[:, s].tolist()
                if held and key != now:
                    yield from handle(held)
                    held = []
                now = key
                held.append(b.slice(s, e - s))
        if held:
            yield from handle(held)

    return run
