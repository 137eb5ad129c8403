"""Files and tables of the engine: recognised words, artifacts, labels, checkpoints, objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TSV = "level array<int>, text array<string>, conf array<double>, left array<double>, top array<double>, width array<double>, height array<double>, block_num array<int>, par_num array<int>, line_num array<int>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
ENTRY = "struct<entry_id:string,ordinal:int,page_index:int,locator:struct<kind:string,column:int,printed_line:int,paragraph:string>,box:array<double>,source_text:string,display_text:string,text_confidence:string,reference_confidence:string>"
ARTIFACT = f"artifact_id string, source_id string, schema_version int, entries array<{ENTRY}>, figure_mentions array<struct<entry_id:string,raw_text:string,span:array<int>,figure_ids:array<string>>>, warnings array<string>"
LABELS = "doc_id string, doc_type string, wrong_document boolean, notes string, references array<struct<ordinal:int,column:int,printed_line:int,paragraph:int,box:array<double>>>, callouts array<struct<value:string,box:array<double>,page_index:int>>, associations array<struct<entry_ordinal:int,value:string,status:string>>, _scaffold struct<verified:boolean>"


def words_from_tsv(pages: DataFrame, min_confidence: float, keys: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """Words of recognised pages (the columns of TSV, page_width, page_height): level 5, not blank, sure enough."""
    zipped = F.arrays_zip("level", "text", "conf", "left", "top", "width", "height", "block_num", "par_num", "line_num")
    w = pages.select(*keys, "page_width", "page_height", F.posexplode(zipped).alias("word_ix", "w")).select(*keys, "page_width", "page_height", "word_ix", "w.*")
    w = w.where((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") >= min_confidence))
    return w.select(
        *keys, "word_ix", F.trim("text").alias("text"), (F.col("left") / F.col("page_width")).alias("x0"), (F.col("top") / F.col("page_height")).alias("y0"),
        ((F.col("left") + F.col("width")) / F.col("page_width")).alias("x1"), ((F.col("top") + F.col("height")) / F.col("page_height")).alias("y1"),
        F.col("conf").alias("confidence"), "block_num", F.col("par_num").alias("paragraph_num"), "line_num",
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of gzipped or plain JSON; absent arrays are empty."""
    df = spark.read.schema(ARTIFACT).json(path)
    return df.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in df.schema if f.dataType.typeName() == "array"})


def entries_of(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(F.col("source_id").alias("doc_id"), F.explode("entries").alias("e")).select("doc_id", "e.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files but examples and unverified scaffolds: without a scaffold a file counts, with one only if it says verified."""
    df = spark.read.schema(LABELS).option("multiLine", True).json(path).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    fine = F.col("_scaffold").isNull() | F.coalesce(F.col("_scaffold.verified"), F.lit(False))
    return df.where(~F.col("_file").startswith("example") & fine).drop("_scaffold").orderBy("_file")


def read_objects(spark: SparkSession, path: str, limit: int, pattern: str = "*") -> DataFrame:
    """path, length, content of objects up to a size; longer ones have a null content, and are not decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.when(F.col("length") <= limit, F.col("content")).alias("content"))


def checkpointed_words(checkpoints: DataFrame, source, kind: str, cache_key: str) -> DataFrame:
    """Words of the pages of a source that were stored under a key; a word is [text, x0, y0, x1, y1, confidence, ...] and may be short."""
    rows = checkpoints.where((F.col("source_id") == F.lit(source)) & (F.col("kind") == kind) & (F.col("cache_key") == cache_key))
    words = rows.select("source_id", "page_index", F.posexplode(F.from_json("payload", "array<array<string>>")).alias("word_ix", "w"))
    at = lambda i: F.get("w", F.lit(i))
    return words.select("source_id", "page_index", "word_ix", at(0).alias("text"), *[at(i).try_cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1", "confidence"), 1)])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; null keys compare as equal."""
    n = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return old.join(n, same, "left_anti").unionByName(new)


def skipped(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """doc_id, reason of labelled documents that no artifact can be scored for."""
    a = artifacts.select("doc_id", F.lit(True).alias("_a")).distinct()
    return cases.join(a, "doc_id", "left").where("_a is null").select("doc_id", F.lit("no_artifact").alias("reason"))
