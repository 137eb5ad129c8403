"""Publication of versions and imports as transactions of a stream's batches.

A batch writes its tables under its epoch and then one manifest row; readers see
only epochs that have one. A batch that died before its manifest is written
over by its next try, and a batch that is repeated after it changes nothing, so
all its tables appear at once and once only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.library import active_version, reusable
from tessera.store import exists

Tables = Callable[[DataFrame], dict[str, DataFrame]]


def sink(root: str, tables: Tables) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: the tables that a batch's rows make, published in one step."""

    def commit(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = f"{root}/manifest/epoch={epoch}"
        if exists(spark, f"{done}/_SUCCESS"):
            return
        made = tables(batch)
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")
        spark.createDataFrame([(sorted(made),)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(done)

    return commit


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table in committed epochs, with their epoch."""
    epochs = spark.read.parquet(f"{root}/manifest").select(F.col("epoch").alias("_e"))
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}").join(epochs, F.col("epoch") == F.col("_e"), "left_semi")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The committed artifacts with is_active (the latest of each source) and is_rollback (the one before it)."""
    return active_version(committed(spark, root, "artifacts"))


def published(batch: DataFrame) -> dict[str, DataFrame]:
    """Tables of a batch of finished extractions: artifacts, and what they make of their documents.

    batch: document_id, source_id, artifact_id, disposition, ready_at, object_key.
    """
    state = F.when(F.col("disposition") == "failed", "failed").when(F.col("disposition").isin("complete_with_warnings", "partial"), "ready_with_warnings").otherwise("ready")
    return {
        "artifacts": batch.select("artifact_id", "source_id", "disposition", "object_key", "ready_at"),
        "documents": batch.where("document_id is not null").select("document_id", F.col("artifact_id").alias("active_artifact_id"), state.alias("state"), "ready_at"),
    }


def imported(batch: DataFrame) -> dict[str, DataFrame]:
    """The four tables and the audit row that a batch of import commits makes.

    batch: import_id, owner_id, status, needs_migration, confirmed, title, sha256, doc_type, object_key, committed_at,
    bookmarks (array of entry_id, label, color). Only analysed imports, and of old layouts only those confirmed, are taken.
    """
    good = batch.where((F.col("status") == "analyzed") & (~F.col("needs_migration") | F.col("confirmed")))
    source, artifact, document = (F.concat(F.lit(p), F.col("import_id")) for p in ("src_", "art_", "doc_"))
    mark = good.select("owner_id", document.alias("document_id"), F.explode("bookmarks").alias("b"))
    return {
        "sources": good.select(source.alias("source_id"), "owner_id", F.lit("import").alias("source_type"), "doc_type", "sha256", F.lit("imported_unverified").alias("state")),
        "artifacts": good.select(artifact.alias("artifact_id"), source.alias("source_id"), F.lit("imported").alias("disposition"), "object_key", F.col("committed_at").alias("ready_at")),
        "documents": good.select(document.alias("document_id"), "owner_id", source.alias("source_id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Imported document")).alias("title"), artifact.alias("active_artifact_id"), F.lit("text_only").alias("state")),
        "bookmarks": mark.select("owner_id", "document_id", "b.entry_id", "b.label", "b.color"),
        "audit": good.select("owner_id", F.lit("import.commit").alias("action"), document.alias("resource_id")),
    }


def cloned(artifacts: DataFrame, sources: DataFrame, requests: DataFrame, owner) -> DataFrame:
    """Rows for published() of requests (document_id, source_id, sha256, config_hash, artifact_id, ready_at) that an owner's complete artifact of the same content answers.

    The copy is an artifact of its own under the request's id: the lives of two sources stay apart.
    """
    have = reusable(artifacts, sources, owner).select("sha256", "config_hash", "disposition", F.col("object_key").alias("copied_from"))
    both = requests.join(have, ["sha256", "config_hash"])
    return both.select("document_id", "source_id", "artifact_id", "disposition", "ready_at", F.concat(F.lit("artifacts/"), F.lit(owner), F.lit("/"), "artifact_id").alias("object_key"), "copied_from")
