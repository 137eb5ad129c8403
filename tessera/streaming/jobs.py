"""Job queue and progress log: batch forms, and the same over streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(requests: DataFrame, key: str, at: str, order: str, cap: int) -> DataFrame:
    """The first cap requests of each key in each minute, numbered."""
    start = F.date_trunc("minute", at)
    w = Window.partitionBy(key, start).orderBy(at, order)
    return requests.withColumns({"window_start": start, "n": F.row_number().over(w)}).where(F.col("n") <= cap)


def rate_counts(stream: DataFrame, key: str, at: str, late: str = "5 minutes") -> DataFrame:
    """Requests of each key in each minute of a stream; later ones than `late` are not counted any more."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 minute"), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def snapshots(log: DataFrame, key: str, sequence: str, last_seen: int) -> DataFrame:
    """The latest row of each key after last_seen."""
    new = log.where(F.col(sequence) > last_seen)
    w = Window.partitionBy(key).orderBy(F.desc(sequence))
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def progress_sequence(log: DataFrame, keys: Sequence[str], state: Sequence[str], order: Sequence[str]) -> DataFrame:
    """log with a sequence that rises by one where the state changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = first
    for c in state:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = log.withColumn("_c", F.when(changed, 1).otherwise(0))
    return rows.withColumn("sequence", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_c")


def fenced(log: DataFrame, job: str, token: str, order: str, terminal: Column) -> DataFrame:
    """Writes with a job's latest token only, and none after its first terminal one."""
    newest = F.max(token).over(Window.partitionBy(job))
    rows = log.withColumn("_t", newest).where(F.col(token) == F.col("_t")).drop("_t")
    done = F.min(F.when(terminal, F.col(order))).over(Window.partitionBy(job))
    return rows.withColumn("_d", done).where(F.col("_d").isNull() | (F.col(order) <= F.col("_d"))).drop("_d")


def to_compute(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has no checkpoint of the same key yet; null keys compare as equal."""
    d = done.select(*keys, "cache_key").distinct().withColumnsRenamed({k: f"_{k}" for k in (*keys, "cache_key")})
    same = F.lit(True)
    for k in (*keys, "cache_key"):
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wanted.join(d, same, "left_anti")


# Which events a job takes in which state.
MOVES = [
    ("queued", "claim", "running"), ("running", "expire", "queued"), ("queued", "cancel", "cancelled"), ("running", "cancel", "cancelling"), ("cancelling", "stopped", "cancelled"),
    ("running", "succeed", "succeeded"), ("running", "fail", "failed"), ("failed", "retry", "queued"), ("cancelled", "retry", "queued"),
]


def final_states(events: DataFrame, job: str = "job_id", event: str = "event", order: str = "seq", start: str = "queued") -> DataFrame:
    """job, state after all its events; an event that the state does not take changes nothing."""
    moves = F.create_map(*[x for a, e, b in MOVES for x in (F.lit(f"{a}/{e}"), F.lit(b))])
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, event))), lambda s: s[event])
    per = events.groupBy(job).agg(steps.alias("_e"))
    return per.select(job, F.aggregate("_e", F.lit(start), lambda s, e: F.coalesce(F.try_element_at(moves, F.concat_ws("/", s, e)), s)).alias("state"))


STATE_SCHEMA = "job_id string, state string, seq long"


def live_states(stream: DataFrame) -> DataFrame:
    """The same over a stream of job_id, seq, event: each batch gives the new state of the jobs in it.

    Events at or before the last sequence seen are passed over, so a restart that
    replays some changes nothing.
    """
    moves = {(a, e): b for a, e, b in MOVES}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else ("queued", -1)
        for r in sorted((int(s), e) for b in batches for s, e in zip(b["seq"], b["event"])):
            if r[0] > last:
                now, last = moves.get((now, r[1]), now), r[0]
        state.update((now, last))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "seq": [last]})

    return stream.groupBy("job_id").applyInPandasWithState(step, STATE_SCHEMA, "state string, seq long", "update", "NoTimeout")


def live_progress(stream: DataFrame, last_seen: int) -> DataFrame:
    """New rows of a progress log; where the reader stands is in the query's checkpoint."""
    return stream.where(F.col("progress_sequence") > last_seen)
