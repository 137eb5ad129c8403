"""Exact top-k by inner product with MaxScore over sign postings.

A dimension d makes two terms, (d, +) and (d, -). A vector stands in the
posting of the term of its component's sign, with the component's size as its
impact. A query's terms are those of its own signs; the terms of opposite signs
can only lower a score, so |q_d| times the largest impact of the posting bounds
what a term adds. MaxScore sorts the query's terms by bound; the longest run of
small bounds that cannot together exceed the k-th best score so far is
non-essential. Only vectors in some essential posting are candidates; the others
are probed dimension by dimension, and only while the bound of what is left keeps
a candidate competitive. Every task is a shard that keeps k rows a query, which
then merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import written

#: Queries that are scored in one pass over the vectors; so many (id, vector) pairs are broadcast at once.
QUERY_SLICE = 4096


class Shard:
    """The postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.cols = ids, np.ascontiguousarray(rows.T)
        self.top = np.maximum(self.cols.max(axis=1), 0), np.maximum(-self.cols.min(axis=1), 0)

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of all vectors that may be among the k best, floor being a score that k others reach already."""
        n, weight = len(self.ids), np.abs(q)
        bound = weight.astype(float) * np.where(q > 0, self.top[0], self.top[1])  # as floats, a little up: sums of bounds may pass 64 bits
        order = np.argsort(bound, kind="stable")
        left = np.cumsum(bound[order]) * (1 + 1e-9) + 1  # of a term and all smaller ones
        if floor is None and n > 4 * k:  # some k vectors' scores are a floor to start with
            some = np.argsort(self.cols[order[-1]] * q[order[-1]], kind="stable")[-(k + 1):]
            some = some[self.ids[some] != own]
            first = q @ self.cols[:, some]
            if len(first) >= k:
                floor = int(np.sort(first)[-k])
        essential = len(order)
        if floor is not None:
            essential = len(order) - int(np.searchsorted(left, float(floor), side="left"))  # smaller terms sum to less than the floor
        if floor is None or floor <= 0 or essential >= len(order):
            at = np.arange(n)
        else:
            hit = np.zeros(n, bool)
            for d in order[len(order) - essential:]:
                hit |= self.cols[d] * (1 if q[d] > 0 else -1) > 0
            at = np.flatnonzero(hit)
        at = at[self.ids[at] != own]
        score = np.zeros(len(at), np.int64)
        for j in range(len(order) - 1, -1, -1):
            d = order[j]
            score += q[d] * self.cols[d][at]
            if floor is not None and j and j % 4 == 0:
                live = score + left[j - 1] >= floor
                if not live.all():
                    at, score = at[live], score[live]
        return self.ids[at], score


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, vec: floor(scale * x) of each component; rows with a null id or vector, or a null or non-finite component, go."""
    x = F.col(vec_col)
    finite: Column = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("vec")
    )


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding", query_slice: int = QUERY_SLICE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by exact integer inner product, ties to the smaller id.

    Queries are the rows that is_query holds for; every row with another id is
    a candidate. Vectors of unequal length are compared as if the shorter went
    on with zeros. Rows that repeat an id each are candidates for other
    queries; as a query, an id counts once, with its smallest vector. An empty
    table gives no rows. Scores must fit a 64-bit integer.

    Queries are taken in slices of about query_slice by a hash of their id, one
    pass over the vectors a slice, whose results are written before the next one is
    sent, so what is broadcast and held has a bound however many there are. Each
    task gives k rows a query at most before the merge.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vec_col, scale)
    queries = integer_vectors(df.where(is_query), id_col, vec_col, scale)
    slices = max(1, math.ceil(queries.count() / query_slice))
    parts = []
    for s in range(slices):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == s).groupBy("id").agg(F.min("vec").alias("vec")).collect()
        if own:
            sent = spark.sparkContext.broadcast([(r["id"], r["vec"]) for r in own])
            parts.append(written(vectors.mapInArrow(_searcher(sent, k), "query_id long, vec_id long, score long"), "best"))
            sent.destroy()  # one slice at a time is held
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(vecs.offsets.to_numpy())
            width = max(int(lengths.max()), max(len(v) for _, v in queries), 1)
            rows = np.zeros((len(ids), width), np.int64)
            rows[np.arange(width) < lengths[:, None]] = vecs.flatten().to_numpy()
            shard = Shard(ids, rows)
            for own, q in queries:
                before = held.get(own)
                floor = int(before[1][-1]) if before and len(before[1]) >= k else None
                got = shard.search(own, np.array(q + [0] * (width - len(q)), np.int64), k, floor)
                if before:
                    got = np.concatenate([before[0], got[0]]), np.concatenate([before[1], got[1]])
                held[own] = best(*got, k)
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.fromiter(held, np.int64), [len(x[0]) for x in held.values()])),
                pa.array(np.concatenate([x[0] for x in held.values()])), pa.array(np.concatenate([x[1] for x in held.values()])),
            ], ["query_id", "vec_id", "score"])

    return run


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
