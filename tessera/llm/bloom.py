"""A Bloom filter of a fixed largest size: what may be broadcast however many ids there are.

It never misses an id it was given, so it may only thin what goes to an exact
join; when it fills up at great sizes it lets more through, and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits at most (4 MB), bits for each id, probes.
MOST_BITS, BITS_EACH, PROBES = 1 << 25, 12, 4
#: Tasks that fill partial filters; each sends one to the driver.
TASKS = 8


def _places(h: np.ndarray, bits: int):
    """Where a 64-bit hash stands in the filter, probe by probe; bits is a power of two."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def build(ids: DataFrame, col: str) -> tuple[np.ndarray, int]:
    """The filter of the non-null values of col, and how many rows went in."""
    n = ids.count()
    bits = 1 << 10
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits <<= 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                own[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.select(F.xxhash64(col)).coalesce(TASKS).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out, n


def may_hold(spark, packed: np.ndarray):
    """A function from an id column to whether the filter may hold it; only the hash goes to Python."""
    sent = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        bits = sent.value
        hit = np.ones(len(h), bool)
        for at in _places(h.to_numpy(), len(bits) * 8):
            hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    def of(col: Column) -> Column:
        return test(F.xxhash64(col))

    return of


def without(df: DataFrame, id_col: str, drop: DataFrame, drop_col: str) -> DataFrame:
    """df less the rows whose id is in drop; rows that the filter rules out are not shuffled.

    Rows with a null id stay, nulls in drop are passed over; repeated rows stay or go together. With nothing to drop, df as it is.
    Beyond some 3 million ids the filter of 4 MB fills up and more and more rows go through the join as well; none is lost.
    """
    packed, n = build(drop, drop_col)
    if not n:
        return df
    hit = may_hold(df.sparkSession, packed)(F.col(id_col))
    rest = df.where(hit).join(drop.select(F.col(drop_col).alias("_drop")).distinct(), F.col(id_col) == F.col("_drop"), "left_anti")
    return df.where(~hit | F.col(id_col).isNull()).unionByName(rest.where(F.col(id_col).isNotNull()))
