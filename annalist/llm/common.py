"""What the training-data operators share: hashing, the split, scratch tables."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialise, release, scratch_root

__all__ = ["Fitted", "discard", "fit_in_task", "held_out", "materialise", "mix64", "read_table", "release", "scratch_root"]


def held_out(doc_id: Column) -> Column:
    """The fixed split: rows whose crc32(doc_id as text) mod 4 is 2 are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Fitted:
    """A model in its pickled form, as it is broadcast; each Python worker reads it once."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __getstate__(self) -> dict:
        return {"data": self.data or pickle.dumps(self._model, 5)}

    @property
    def model(self) -> Any:
        if "_model" not in self.__dict__:
            self._model, self.data = pickle.loads(self.data), b""
        return self._model


def fit_in_task(rows: DataFrame, train: Callable[[list[pa.RecordBatch]], Any]) -> Fitted:
    """Train on all of ``rows``, whose size a parameter of the caller bounds, in
    one task, so that the driver holds the finished model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pickle.dumps(train(list(batches)), 5)
        gc.collect()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["model"])
        del data
        pa.default_memory_pool().release_unused()

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return Fitted(bytes(got[0]["model"]) if got else pickle.dumps(train([]), 5))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
