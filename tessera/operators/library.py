"""Queries of a document library: ownership, listings, queue, usage, placement, reuse and deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owned(df: DataFrame, owner_col: str, owner, state_col: str | None = None, deleted: str = "deleted") -> DataFrame:
    """Rows of one owner that are not deleted."""
    own = F.col(owner_col) == F.lit(owner)
    return df.where(own & (F.col(state_col) != deleted) if state_col else own)


def in_workspace(df: DataFrame, col: str, workspace) -> DataFrame:
    """Rows of a workspace; None takes those of no workspace."""
    return df.where(F.col(col).eqNullSafe(F.lit(workspace)))


def latest_per(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def claimable(status: Column, lease: Column, now: Column) -> Column:
    """Queued, or running with a lease that has run out; a null lease has not."""
    return (status == "queued") | ((status == "running") & F.coalesce(lease < now, F.lit(False)))


def next_claim(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest claimable job with its attempt counted up and a new fencing token."""
    got = jobs.where(claimable(F.col("status"), F.col("lease_until"), now)).orderBy("created_at", "job_id").limit(1)
    return got.withColumns({"status": F.lit("running"), "attempt": F.col("attempt") + 1, "fence": F.col("fence") + 1})


def reaped(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs with an expired lease go back to the queue without a lease."""
    late = (F.col("status") == "running") & F.coalesce(F.col("lease_until") < now, F.lit(False))
    return jobs.withColumns({"status": F.when(late, "queued").otherwise(F.col("status")), "lease_until": F.when(~late, F.col("lease_until"))})


def usage(audit: DataFrame, keys: Sequence[str], counted: dict[str, Column], fields: dict[str, str], details: str, at: str, used: Column) -> DataFrame:
    """Per key: counts of events, sums of JSON number fields of usage events (missing is 0), latest usage time."""
    sums = {name: F.coalesce(F.sum(F.when(used, F.coalesce(F.get_json_object(details, path).cast("bigint"), F.lit(0)))), F.lit(0)) for name, path in fields.items()}
    return audit.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counted.items()], *[c.alias(n) for n, c in sums.items()], F.max(F.when(used, F.col(at))).alias("last_used"))


def grouped_with_unfiled(groups: DataFrame, rows: DataFrame, key: str, name: str, unfiled: str = "Unfiled") -> DataFrame:
    """Number of rows in each group, empty groups and the bucket of rows without one included."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    filed = groups.select(key, name).join(counts, key, "left").select(F.col(name).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))
    known = groups.select(F.col(key).alias("_k"))
    rest = rows.join(known, F.col(key) == F.col("_k"), "left_anti").agg(F.count("*").alias("n")).select(F.lit(unfiled).alias("bucket"), "n")
    return filed.union(rest)


def placed_before(rows: DataFrame, group: str, position: str, row_id: str, moved, target: int, to_group) -> DataFrame:
    """Positions after one row moves before position `target` of a group; both lists are numbered anew from 0."""
    is_it = F.col(row_id) == F.lit(moved)
    placed = rows.withColumns({group: F.when(is_it, F.lit(to_group)).otherwise(F.col(group)), "_at": F.when(is_it, F.lit(target - 0.5)).otherwise(F.col(position).cast("double"))})
    w = Window.partitionBy(group).orderBy("_at", row_id)
    return placed.withColumn(position, F.row_number().over(w) - 1).drop("_at")


def reusable(artifacts: DataFrame, sources: DataFrame, owner, digest_col: str = "sha256") -> DataFrame:
    """The latest complete artifact of each content of an owner."""
    both = artifacts.where(F.col("object_key").isNotNull() & F.col("ready_at").isNotNull() & F.col("disposition").isin("complete", "complete_with_warnings"))
    both = both.join(sources.where(F.col("owner_id") == F.lit(owner)).select("source_id", digest_col), "source_id")
    return latest_per(both, [digest_col, "config_hash"], [F.desc("ready_at"), F.desc("artifact_id")])


def purge_plan(documents: DataFrame, doomed: DataFrame) -> DataFrame:
    """source_id, shared: whether another document still needs the source of a doomed one."""
    gone = documents.join(doomed.select("document_id"), "document_id", "left_semi")
    left = documents.join(doomed.select("document_id"), "document_id", "left_anti").select("source_id").distinct().withColumn("_s", F.lit(True))
    return gone.select("source_id").distinct().join(left, "source_id", "left").select("source_id", F.coalesce("_s", F.lit(False)).alias("shared"))


def active_version(artifacts: DataFrame) -> DataFrame:
    """The latest artifact of each source is active, the one before it the rollback."""
    w = Window.partitionBy("source_id").orderBy(F.desc("ready_at"), F.desc("artifact_id"))
    n = F.row_number().over(w)
    return artifacts.withColumns({"is_active": n == 1, "is_rollback": n == 2})


def latest_state(events: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], deleted: str | None = None, keep_null: bool = False) -> DataFrame:
    """The state of each key after its events: per field the last value, or with keep_null=False the last one that is not null. Keys whose last event is a deletion go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = events.select(*keys, *[F.last(f, ignorenulls=not keep_null).over(w).alias(f) for f in fields], *([F.last(deleted).over(w).alias("_d")] if deleted else []), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_n"))
    rows = rows.where("_n = 1").drop("_n")
    return rows.where(~F.coalesce("_d", F.lit(False))).drop("_d") if deleted else rows


def unfiled_on_delete(documents: DataFrame, deleted_workspaces: DataFrame) -> DataFrame:
    """Documents of deleted workspaces are in none."""
    gone = deleted_workspaces.select(F.col("workspace_id").alias("_w")).distinct()
    return documents.join(gone, F.col("workspace_id") == F.col("_w"), "left").withColumn("workspace_id", F.when(F.col("_w").isNull(), F.col("workspace_id"))).drop("_w")


def search(entries: DataFrame, scope: DataFrame, hit: Column, key: str) -> DataFrame:
    """Hits within a scope; where the scope has none, hits anywhere."""
    found = entries.where(hit)
    scoped = found.join(scope.select(key), key, "left_semi")
    none = scoped.agg(F.count("*").alias("_n"))
    return scoped.unionByName(found.crossJoin(F.broadcast(none)).where("_n = 0").drop("_n"))  # one row


def replaced_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def first_wins_union(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which the last of the parts that has a key gives its row."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    return latest_per(rows, keys, [F.desc("_p"), *[F.col(k) for k in keys]]).drop("_p")


def evenly_sampled(df: DataFrame, order: Sequence[str], n: int, group: Sequence[str] = ()) -> DataFrame:
    """n rows at the places floor(i * count / n) of each group, or all if there are fewer."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.partitionBy(F.lit(0)).orderBy(*order)
    size = F.count("*").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_c": size})
    # Row i is the place of j = ceil(i * n / count) if that j's place is i again.
    j = F.ceil(F.col("_i") * n / F.col("_c"))
    return rows.where((F.col("_c") <= n) | ((j < n) & (F.floor(j * F.col("_c") / n) == F.col("_i")))).drop("_i", "_c")
