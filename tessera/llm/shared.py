"""What the operators of this subpackage share: written tables and row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in spark.checkpoint.dir. Only where
    that is unset, and Spark runs in this one process, a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts the
    lineage, and a lost executor costs no more than a new read.

    row_group: bytes of a row group, if rows are wide. A writer holds one, and a reader turns up to 4,096 rows of one into vectors at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.size": row_group} if row_group else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2 MB for what goes to Python, in place of Spark's 64: a task holds a few copies of one, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text: two columns whatever else df holds; a null text is empty."""
    lean_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(text)
