"""The training-data pipeline over documents: each stage reads what the one before wrote.

STAGES: (name, function) with function(spark, docs, sf_dir) -> DataFrame. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bloom, byte_bpe, decontaminate, minhash, secrets, toxicity
from tessera.llm.shared import forget, row_key, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rates toxic go.

    A null or empty text is never toxic; rows that repeat are rated alike, and a null id's row by its text. An empty
    table stays empty; without labels nothing goes. Texts are read whole; columns other than COLUMNS are left behind.
    """
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = toxicity.score(docs, chain, keep=[c for c in COLUMNS if c != "doc_id"])
    return rated.where(~F.col("is_toxic")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; of rows that repeat an id, all of it do.

    Rows with a null id, and null, empty or wordless texts, stay; an empty table stays empty. Texts are compared whole.
    """
    found = minhash.near_duplicates(docs, size=5, num=80, den=100)
    copies = written(found.where(~F.col("kept")).select("doc_id"), "copies")  # read three times
    return bloom.without(docs.select(*COLUMNS), "doc_id", copies, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none; of rows that share an id only those whose own text holds one go, repeats of such a
    row with it. An empty table, or an empty benchmark, changes nothing. Texts are searched whole.
    """
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.select(F.col("doc_id").alias("i"), F.col("row_key").alias("k")).distinct()
    rows = docs.select(*COLUMNS)
    key = row_key(F.coalesce(F.col("text"), F.lit("")))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("i")) & (key == F.col("k")), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span of a secret is replaced by [SECRET]; no document goes. Rows without a candidate pass by the join.

    A null text stays null; n_chars follows a text that changed. Repeated rows come out as often, rows of a null id too.
    """
    found = secrets.scan(docs, repository=F.concat_ws("/", "source", "lang"), owner="source").where(F.size("found") > 0)
    found = found.select(F.col("doc_id").alias("i"), F.col("row_key").alias("k"), "found").distinct()
    rows = docs.select(*COLUMNS).withColumn("some", F.coalesce(secrets.may_hold(F.col("text")), F.lit(False)))
    joined = rows.where("some").join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (row_key(F.col("text")) == F.col("k")), "left")
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("found")))
    masked = joined.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))
    return rows.where(~F.col("some")).select(*COLUMNS).union(masked)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the digests of the encoding and its way back; a null text is empty. Row in, row out, texts of any length."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: The trained chain, MinHash and byte-pair merging are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what one wrote is deleted once the next has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return docs
