"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from offerscope.session import shared_dir

MEMO_ENTRIES = 250_000
MEMO_KEY = 64  # longer keys are worked out each time, so that entries bound the bytes too
_SPACE_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
_SPACE_BEFORE_TEXT = re.compile(r" (?=\S)")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write to a fresh table in the cluster's shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps what Python computed from being computed twice.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list[Row]:
    """All rows of a table that has a proven bound, on the driver; beyond the bound an error, never a part."""
    rows = df.take(bound + 1)
    if len(rows) > bound:
        raise RuntimeError(f"{what}: more than the {bound} rows that are possible")
    return rows


def packed(df: DataFrame, text: str) -> DataFrame:
    """The text as ``_text`` and all other columns in one struct ``_row``: whatever they are called, they can't clash
    with columns that an operator adds."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("_row"), F.col(text).alias("_text"))


def unpacked(df: DataFrame, like: DataFrame, text: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``like`` from a packed table; ``changed`` gives new values of some."""
    new = {text: F.col("_text")} | (changed or {})
    return df.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in like.columns))


class Memo(dict):
    """Remembers a pure function of its key: between ``entries`` and twice as many recent keys, none of them long."""

    def __init__(self, function: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.entries, self.older = function, entries, {}

    def __missing__(self, key):
        if not isinstance(key, int) and len(key) > MEMO_KEY:
            return self.function(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value


def split_chunks(text: str) -> list[str]:
    """Cut a text before every space that is followed by other than white space.

    Byte-level vocabularies attach such a space to what follows, so no token crosses these places and
    every chunk can be encoded, and its result remembered, on its own. The space is left out of the
    returned strings: all but the first stand for " " + chunk.
    """
    if _SPACE_BEFORE_SPACE.search(text):
        return _SPACE_BEFORE_TEXT.split(text)
    return text.split(" ")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def batches_of(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t) for v, t in columns.values()], names=list(columns)
    )


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


Batches = Iterator[pa.RecordBatch]
