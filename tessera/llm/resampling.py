"""Target-distribution importance resampling over hashed word runs.

The document-by-bucket count matrix is written once, as blocks of compressed
sparse rows. Its column sums are the corpus's distribution; those of the target
texts give the other one. A bucket's gain is the scaled logarithm of their
ratio, and the matrix times the gains gives each document's weight. A Gumbel
draw from the document's id is added, and the highest scores are the sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import forget, texts, written

#: Features and rows of a block at most (one longer document is a block of its own, with no more columns than buckets).
BLOCK_FEATURES, BLOCK_ROWS = 20_000, 2_000
#: Bytes of a row group of blocks: what a task holds of them does not grow with its file.
ROW_GROUP = 4 << 20
#: Words that a worker remembers; beyond it starts anew.
CACHE = 200_000
#: Bytes of words as they are, with A-Z in lower case; all others are spaces.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters a to z (after A-Z are lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_BYTES).split()


class Buckets:
    """The buckets of a text's features, each run of 1 to longest words, repeats included."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.cache = longest, buckets, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        cache, n = self.cache, self.buckets
        try:
            one = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for w in set(words):
                cache[w] = zlib.crc32(w) % n
            one = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        runs = [one]
        for k in range(2, self.longest + 1):
            runs.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) % n for i in range(len(words) - k + 1)), np.int64, max(0, len(words) - k + 1)))
        return np.concatenate(runs)


def csr_blocks(df: DataFrame, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_ids, n_words, indptr, indices, data: a row a block of documents; row i has indices[indptr[i]:indptr[i + 1]] and as many counts."""
    docs = texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(ids: pa.Array, held: list[np.ndarray], words: list[int]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(held)), [len(x) for x in held])
        key, data = np.unique(row * buckets + (np.concatenate(held) if held else row), return_counts=True)
        indptr = np.searchsorted(key, np.arange(len(held) + 1) * buckets)
        one = lambda x: pa.array([x])
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(words), one(indptr.astype(np.int32)), one((key % buckets).astype(np.int32)), one(data.astype(np.int32))],
            ["doc_ids", "n_words", "indptr", "indices", "data"],
        ).cast(schema(ids.type))

    def schema(of: pa.DataType) -> pa.Schema:
        ints = pa.list_(pa.int32())
        return pa.schema([("doc_ids", pa.list_(of)), ("n_words", pa.list_(pa.int64())), ("indptr", ints), ("indices", ints), ("data", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Buckets(longest, buckets)
        for b in batches:
            at, held, words, size = 0, [], [], 0
            for i, t in enumerate(b.column(1)):
                w = words_of(t.as_py())
                held.append(own(w)), words.append(len(w))
                size += len(held[-1])
                if size >= BLOCK_FEATURES or len(held) >= BLOCK_ROWS:
                    yield block(b.column(0).slice(at, len(held)), held, words)
                    at, held, words, size = i + 1, [], [], 0
            if held:
                yield block(b.column(0).slice(at, len(held)), held, words)

    return docs.mapInArrow(run, f"doc_ids array<{kind}>, n_words array<long>, indptr array<int>, indices array<int>, data array<int>")


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; a task sums its blocks, and the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (b.column(i).flatten().to_numpy() for i in (0, 1))
            own += np.bincount(at, n, buckets).astype(np.int64)  # a batch's counts are exact as doubles
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("indices", "data").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of the target's smoothed share of a bucket to the corpus's)."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float(y + 1) * float(s + n) / (float(x + 1) * float(t + n)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the blocks' rows times the gains."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, words, indptr, indices, data = (c.slice(i, 1).flatten() for c in b.columns)
                indptr, data = indptr.to_numpy(), data.to_numpy().astype(np.int64)
                rows = lambda x: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[indptr])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(rows(data)), pa.array(rows(data * sent.value[indices.to_numpy()]))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """floor(scale * a Gumbel draw) by the first 32 bits of sha256(seed:id); a null id is written as no characters."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank (from 1) in the order of all its rows: sorted over all tasks by ranges, each of which begins after those before it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "sorted")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    begin, starts = 0, []
    for p, n in sizes:
        starts.append((p, begin))
        begin += n
    starts = F.broadcast(spark.createDataFrame(starts, "_part long, _begin long"))
    return rows.join(starts, part == F.col("_part")).withColumn("rank", F.col("_begin") + at + 1).drop("_at", "_part", "_begin")


def resample(
    df: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (among those drawn; null for the others).

    percent of the documents of min_words words and more are drawn: those of the
    highest scores, ties to the smaller id. A null text has no words. Repeated
    rows are documents each, of equal score and neighbouring ranks; a null id comes after all
    others. An empty table gives no rows; an empty target leaves all gains to
    the corpus. Texts of any length are counted whole; other columns are not read.

    Texts are read once: what follows reads the blocks. The driver and each
    task hold a number a bucket.
    """
    blocks = written(csr_blocks(df, longest, buckets, id_col, text_col), "csr", ROW_GROUP)
    corpus = column_sums(blocks, buckets)
    goal = column_sums(csr_blocks(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), longest, buckets), buckets)
    scored = weights(blocks, gains(corpus, goal)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "scored")
    forget(blocks)
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    rank = F.col("rank").cast("long")
    out = ["doc_id", "n_features", "weight", "score"]
    some = ranked(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")])
    return some.select(*out, F.when(rank <= drawn, rank).alias("rank")).union(scored.where(~able).select(*out, F.lit(None).cast("long")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Words, crc32 by a table that eight shifts a byte make, and the rest by the same rule.
OP12_SQL = r"""
WITH RECURSIVE shifted(b, c, i) AS (
  SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM shifted WHERE i < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM shifted WHERE i = 8),
split AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 1, 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), feature AS (SELECT side, r, unnest(ws) AS w FROM split),
word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM feature)),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b
  FROM word, crc
), n AS (SELECT side, b, count(*) AS n FROM feature JOIN bucket USING (w) GROUP BY side, b),
total AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n),
gain AS (
  SELECT x.b, CAST(floor(1000 * ln((coalesce(y.n, 0) + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((x.n + 1)::DOUBLE * (total.t + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM total, (SELECT b, n FROM n WHERE side = 0) x LEFT JOIN (SELECT b, n FROM n WHERE side = 1) y ON x.b = y.b
), weight AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM feature JOIN bucket USING (w) JOIN gain USING (b) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weight USING (r) WHERE side = 0
), able AS (
  SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
