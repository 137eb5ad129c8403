"""Small groups in one pass over a partition that is sorted by them: a group costs no more than its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes back.
ROWS = 10_000


def each_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[list[dict]], Iterable[Sequence]], schema: StructType) -> DataFrame:
    """What work gives for the rows of each group, as rows of schema; a task holds one group at a time.

    Rows are brought together by keys and come in order. work takes them as dictionaries.
    """
    arrow = to_arrow_schema(schema)

    def dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def batch(out: list[Sequence]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Sequence] = []
        for _, group in groupby(dicts(batches), itemgetter(*keys)):
            out += work(list(group))
            if len(out) >= ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
