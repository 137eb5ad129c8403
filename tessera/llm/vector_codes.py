"""Compression of vectors to short codes, one byte for each part of a vector.

Each part position has a codebook. A round broadcasts a kd-tree over each
codebook, finds every part's nearest entry by branch and bound, and replaces the
entries by the integer means of their parts, from sums that tasks make and Spark
adds up. Everything is integer arithmetic, so the result does not depend on how
rows are spread. A branch whose bound equals the best distance so far is
visited as well: it may hold an equally near entry of a lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import written

#: Entries of a leaf at most, and rows that are searched for at once.
LEAF, BLOCK = 8, 4096
#: Components must be smaller: squared distances of 128 of them then fit 64 bits, and so do sums over 3e10 rows.
LARGEST = 1 << 27


@dataclass
class Node:
    low: np.ndarray  # the box around its entries
    high: np.ndarray
    entries: np.ndarray | None = None  # indexes, of a leaf
    axis: int = 0
    at: int = 0  # below or at it: left
    children: list[Node] = field(default_factory=list)


class KdTree:
    """Nearest entries of one codebook, ties to the lowest index."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.root = self._node(np.arange(len(book)))

    def _node(self, some: np.ndarray) -> Node:
        own = self.book[some]
        node = Node(own.min(axis=0), own.max(axis=0))
        spread = node.high - node.low
        if len(some) <= LEAF or not spread.any():
            node.entries = np.sort(some)
            return node
        node.axis = int(spread.argmax())
        values = np.sort(own[:, node.axis])
        node.at = int(values[(len(values) - 1) // 2])
        if node.at == values[-1]:  # more than half are the largest value: those below it go left
            node.at = int(values[values < node.at][-1])
        left = own[:, node.axis] <= node.at
        node.children = [self._node(some[left]), self._node(some[~left])]
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of points."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.book), np.int64)

        def leaf(node: Node, rows: np.ndarray) -> None:
            for e in node.entries:
                off = points[rows] - self.book[e]
                far = np.einsum("ij,ij->i", off, off)
                new = (far < best[rows]) | ((far == best[rows]) & (e < index[rows]))
                best[rows[new]], index[rows[new]] = far[new], e

        def descend(node: Node, rows: np.ndarray) -> None:
            """Each row's own leaf gives it a first bound."""
            if not len(rows):
                return
            if node.entries is not None:
                return leaf(node, rows)
            left = points[rows, node.axis] <= node.at
            descend(node.children[0], rows[left])
            descend(node.children[1], rows[~left])

        def search(node: Node, rows: np.ndarray) -> None:
            off = np.maximum(np.maximum(node.low - points[rows], points[rows] - node.high), 0)
            rows = rows[np.einsum("ij,ij->i", off, off) <= best[rows]]
            if not len(rows):
                return
            if node.entries is not None:
                return leaf(node, rows)
            for child in node.children:
                search(child, rows)

        every = np.arange(len(points))
        descend(self.root, every)
        search(self.root, every)
        return index, best


def kept_vectors(df: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vec: floor(scale * x) of each component; rows with a null vector, or a null or non-finite component, go."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return df.where(x.isNotNull()).where(finite).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vec")
    )


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as a matrix; shorter vectors go on with zeros."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            vecs = b.column(column)
            lengths = pc.list_value_length(vecs).to_numpy()
            rows = np.zeros((b.num_rows, width), np.int64)
            rows[np.arange(width) < lengths[:, None]] = vecs.flatten().to_numpy()
            yield b, rows


@dataclass
class Codes:
    """rows: vec_id, label, code, error. books: part by entry by position."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of every kept vector: an entry of each part's codebook, two hexadecimal digits each, and the squared distances summed over parts.

    The codebooks begin as the parts of the vectors of the smallest ids (equal
    ids by their vectors; fewer entries if there are fewer vectors; null ids
    last). Rows with a null vector, or a null or non-finite component, take no
    part; vectors shorter than the longest, or than a multiple of parts, go on
    with zeros. Repeated rows and null ids count as rows like others. An empty
    table gives no rows and empty codebooks. Other columns are not read.
    Components of LARGEST and more (after scaling) raise a ValueError.

    What is broadcast and what the driver collects in a round are the codebooks
    and their sums: parts * entries rows, whatever the size of the table.
    """
    if entries > 256:
        raise ValueError("an entry must fit two hexadecimal digits")
    spark = df.sparkSession
    sc = spark.sparkContext
    kept = kept_vectors(df, scale, id_col, vec_col, label_col)
    size, most = kept.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    if (most or 0) >= LARGEST:
        raise ValueError(f"components after scaling must be smaller than {LARGEST}")
    width = -(-max(size or 0, 1) // parts) * parts
    vectors = written(kept.withColumn("vec", F.col("vec").cast("array<int>")), "vectors")
    first = [r["vec"] for r in vectors.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()]
    start = np.zeros((len(first), width), np.int64)
    for row, v in zip(start, first):
        row[: len(v)] = v
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    if not first:
        return Codes(vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books)
    for _ in range(rounds):
        books = _moved(vectors, sc.broadcast([KdTree(b) for b in books]), books)
    trees = sc.broadcast([KdTree(b) for b in books])
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _blocks(batches, 2, width):
            found = [t.nearest(p) for t, p in zip(trees.value, np.split(rows, parts, axis=1))]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return Codes(written(vectors.select("vec_id", "label", "vec").mapInArrow(run, f"{kinds}, code string, error long"), "codes"), books)


def _moved(vectors: DataFrame, trees, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts, unused ones as they were."""
    parts, entries, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((parts, entries, each + 1), np.int64)  # last: how many
        for _, rows in _blocks(batches, 0, parts * each):
            for part, (tree, points) in enumerate(zip(trees.value, np.split(rows, parts, axis=1))):
                index, _ = tree.nearest(points)
                np.add.at(own[part], index, np.concatenate([points, np.ones((len(points), 1), np.int64)], axis=1))
        at = np.flatnonzero(own[:, :, -1].ravel())
        for some in np.array_split(at, max(1, len(at) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(own.reshape(-1, each + 1)[some]), pa.list_(pa.int64()))], ["entry", "sums"])

    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(each + 1)]
    out = books.copy().reshape(parts * entries, each)
    for r in vectors.select("vec").mapInArrow(run, "entry long, sums array<long>").groupBy("entry").agg(*sums).collect():
        out[r["entry"]] = [r[i + 1] // r[each + 1] for i in range(each)]
    return out.reshape(books.shape)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the errors of all rows of the same label (null labels together) summed."""
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(codes.rows).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by comparing every part with every entry."""
    assign = """near{i} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT r, p.part, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN book{i} b ON p.part = b.part
  ) GROUP BY r, part)"""
    move = """book{j} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM (
      SELECT p.part, m.e AS e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM near{i} JOIN p USING (r, part), (SELECT unnest(range(1, (SELECT len(x) FROM p LIMIT 1) + 1)) AS k) GROUP BY p.part, m.e, k
    ) GROUP BY part, e) n ON n.part = b.part AND n.e = b.e)"""
    steps = "".join(",\n" + assign.format(i=i) + ",\n" + move.format(i=i, j=i + 1) for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, CAST(k AS INTEGER) AS part, vec[CAST(k * len(vec) // {parts} + 1 AS INTEGER) : CAST((k + 1) * len(vec) // {parts} AS INTEGER)] AS x FROM v, (SELECT unnest(range({parts})) AS k)
), book0 AS (SELECT part, r AS e, x AS c FROM p WHERE r < {entries}){steps},
{assign.format(i=rounds)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(m.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, e, k)) AS h FROM (SELECT part, e, unnest(c) AS y, generate_subscripts(c, 1) AS k FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN v USING (r), digest
"""


OP13_SQL = _sql()
