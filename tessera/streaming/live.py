"""Queue, progress and rate limits over streams: what a key has so far is keyed state, what runs out is a timer.

Times are event times: a timer runs when the stream's watermark passes it, so a
log that is replayed, or read on after a restart, gives the rows that the batch
forms give for the same log.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

MINUTE = 60_000
TERMINAL = ("succeeded", "failed", "cancelled")  # Fixed values.


def _stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema, time: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", time)


class _Limiter(StatefulProcessor):
    """Admissions of a key in each minute that is open, as one value; minutes are forgotten once the watermark is past their end."""

    def __init__(self, order: str, cap: int):
        self.order, self.cap = order, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.admitted = handle.getValueState("admitted", "minute array<bigint>, n array<int>")

    def _open(self, past_ms: int) -> dict[int, int]:
        return {m: n for m, n in zip(*(self.admitted.get() or ((), ()))) if (m + 1) * MINUTE > past_ms}

    def _keep(self, open_minutes: dict[int, int]) -> None:
        if open_minutes:
            self.admitted.update((list(open_minutes), list(open_minutes.values())))
            self.handle.registerTimer((max(open_minutes) + 1) * MINUTE)
        else:
            self.admitted.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = [x for x in rows if len(x)]
        if not some:
            return
        pdf = pd.concat(some).sort_values(["limit_ms", self.order], ignore_index=True)
        minute = pdf["limit_ms"] // MINUTE
        before = self._open(timerValues.getCurrentWatermarkInMs())
        n = pdf.groupby(minute).cumcount() + 1 + minute.map(before).fillna(0).astype("int64")
        asked = minute.value_counts().to_dict()
        self._keep({**before, **{int(m): min(self.cap, before.get(m, 0) + int(k)) for m, k in asked.items()}})
        yield pdf.assign(n=n.astype("int32"))[n <= self.cap].drop(columns=["limit_ms", "limit_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._open(expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def admitted(stream: DataFrame, key: str, at: str, order: str, cap: int, late: str = "5 minutes") -> DataFrame:
    """The requests that a limit of cap a key and minute lets through, numbered: of a batch by at and order, after those of earlier batches."""
    schema = StructType([*stream.schema, StructField("n", IntegerType())])
    rows = stream.withColumn("limit_at", F.col(at).cast("timestamp")).withWatermark("limit_at", late).withColumn("limit_ms", F.unix_millis("limit_at"))
    return _stateful(rows, [key], _Limiter(order, cap), schema, "EventTime")


class _Progress(StatefulProcessor):
    """The last sequence a job has shown, and whether it has ended."""

    def __init__(self, sequence: str, status: str, last_seen: int, keep_ms: int | None):
        self.sequence, self.status, self.last_seen, self.keep_ms = sequence, status, last_seen, keep_ms

    def init(self, handle) -> None:
        self.shown = handle.getValueState("shown", "last long, ended boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, ended = self.shown.get() or (self.last_seen, False)
        some = [x for x in rows if len(x)]
        if ended or not some:
            return
        pdf = pd.concat(some).sort_values(self.sequence, ignore_index=True)
        new = pdf[pdf[self.sequence] > last]
        if not len(new):
            return
        end = new[self.status].isin(TERMINAL)
        if end.any():
            new = new.loc[: end.idxmax()]
        self.shown.update((int(new[self.sequence].iloc[-1]), bool(end.any())))
        yield new.tail(1)  # the newest state stands for those before it

    def close(self) -> None:
        pass


def progress(stream: DataFrame, key: str, sequence: str, status: str, last_seen: int = 0, keep_ms: int | None = None) -> DataFrame:
    """Per batch and job the newest row after the last one shown (at first last_seen), up to the job's end; nothing after it.

    What was shown is in the query's checkpoint, so a restart goes on from there. With keep_ms, the state of
    jobs without news for so long goes; such a query watches the clock, so it runs until it is stopped.
    """
    return _stateful(stream, [key], _Progress(sequence, status, last_seen, keep_ms), stream.schema, "None" if keep_ms is None else "ProcessingTime")


LOG = "queue string, seq long, ms long, event string, job_id string, worker string, token string"
CLAIMS = "queue string, seq long, ms long, event string, job_id string, worker string, token string, accepted boolean, status string, attempt int, lease_until long"
Job = tuple[int, str, int, "str | None", "str | None", "int | None"]  # created (seq), status, attempt, worker, token, lease_until


class Jobs(dict):
    """Jobs of a queue by id, those queued in the order of their making and those on lease by its end: no event looks at all of them.

    A heap's entry counts as long as it is what the job says.
    """

    def __init__(self, kept: Iterable[tuple[str, Job]] = ()):
        super().__init__()
        self.waiting: list[tuple[int, str]] = []
        self.leases: list[tuple[int, str]] = []
        for k, j in kept:
            self[k] = j

    def __setitem__(self, k: str, j: Job) -> None:
        super().__setitem__(k, j)
        if j[1] == "queued":
            heapq.heappush(self.waiting, (j[0], k))
        if j[5] is not None:
            heapq.heappush(self.leases, (j[5], k))

    def oldest(self) -> str | None:
        while self.waiting and self[self.waiting[0][1]][:2] != (self.waiting[0][0], "queued"):
            heapq.heappop(self.waiting)
        return self.waiting[0][1] if self.waiting else None

    def run_out(self, ms: int) -> Iterator[tuple[int, str]]:
        while self.leases and self.leases[0][0] < ms:
            lease, k = heapq.heappop(self.leases)
            if self[k][5] == lease:
                yield lease, k


def step(jobs: Jobs, event: dict, lease_ms: int) -> Iterator[tuple]:
    """Rows of CLAIMS (but the queue) that an event of a queue makes; jobs is changed.

    Events: submit (a job), claim (a worker takes the oldest job that is queued),
    heartbeat, succeed, fail and stop (with the job's token), cancel, retry.
    Before an event, leases that ran out before it are given back, in the order
    in which they ran out. A wrong token or state is not accepted and changes nothing.
    """
    yield from expired(jobs, event["ms"])
    kind, job = event["event"], event["job_id"]
    if kind == "claim":
        job = jobs.oldest()
    old = jobs.get(job)
    if kind == "submit":
        new = None if old else (event["seq"], "queued", 0, None, None, None)
    elif old is None:
        new = None
    else:
        created, status, attempt, worker, token, lease = old
        mine = status in ("running", "cancelling") and token is not None and event["token"] == token
        if kind == "claim":
            new = (created, "running", attempt + 1, event["worker"], f"{job}:{attempt + 1}", event["ms"] + lease_ms)
        elif kind == "heartbeat":
            new = (created, status, attempt, worker, token, event["ms"] + lease_ms) if mine else None
        elif kind in ("succeed", "fail", "stop"):
            after = {"succeed": "succeeded", "fail": "failed", "stop": "cancelled"}[kind]
            new = (created, after, attempt, worker, None, None) if mine and (kind != "stop" or status == "cancelling") else None
        elif kind == "cancel":
            after = {"queued": "cancelled", "running": "cancelling"}.get(status)
            new = (created, after, attempt, worker, token, lease) if after else None
        elif kind == "retry":
            new = (created, "queued", attempt, None, None, None) if status in ("failed", "cancelled") else None
        else:
            new = None
    if new:
        jobs[job] = new
    now = new or old
    yield (event["seq"], event["ms"], kind, job, event["worker"], now[4] if now else None, bool(new), now[1] if now else None, now[2] if now else None, now[5] if now else None)


def expired(jobs: Jobs, ms: int) -> Iterator[tuple]:
    """Jobs whose lease ran out before ms: those running are queued again, those that were to stop are cancelled."""
    for lease, job in jobs.run_out(ms):
        created, status, attempt, worker, token, _ = jobs[job]
        after = "queued" if status == "running" else "cancelled"
        jobs[job] = (created, after, attempt, None, None, None)
        yield (None, lease, "expire", job, worker, token, True, after, attempt, None)


def _frame(queue, rows: Iterable[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in CLAIMS.split(", ")]
    out = pd.DataFrame([(queue, *r) for r in rows], columns=names)
    return out.astype({"seq": "Int64", "attempt": "Int32", "lease_until": "Int64"})


def _events(pdf: pd.DataFrame, many: int = 10_000) -> Iterator[list[dict]]:
    """The events of a log by their number, some at a time."""
    pdf = pdf.sort_values("seq", ignore_index=True)
    for i in range(0, len(pdf), many):
        part = pdf.iloc[i : i + many].astype(object)
        yield part.where(part.notna(), None).to_dict("records")


class _Queue(StatefulProcessor):
    """The jobs of a queue, with a timer for each lease; a timer looks at the jobs of its lease only."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", "created long, status string, attempt int, worker string, token string, lease_until long")
        self.leases = handle.getMapState("leases", "lease_until long", "job_ids array<string>")
        self.last = handle.getValueState("last", "seq long")

    def _keep(self, before: dict[str, Job], now: dict[str, Job]) -> None:
        ends: dict[int, list[str]] = {}
        for k, j in now.items():
            if before.get(k) != j:
                self.jobs.updateValue((k,), j)
                if j[5] is not None:
                    ends.setdefault(j[5], []).append(k)
        for lease, ids in ends.items():
            held = self.leases.getValue((lease,)) if self.leases.containsKey((lease,)) else None
            self.leases.updateValue((lease,), (sorted({*ids, *(held[0] if held else ())}),))
            self.handle.registerTimer(lease + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        jobs, (last,) = Jobs(before.items()), self.last.get() or (-1,)
        for events in _events(pd.concat(list(rows))):
            out = []
            for e in events:
                if e["seq"] > last:  # what a restart replays is passed over
                    out += step(jobs, e, self.lease_ms)
                    last = e["seq"]
            yield _frame(key[0], out)
        self._keep(before, jobs)
        self.last.update((int(last),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = expiredTimerInfo.getExpiryTimeInMs() - 1
        ids = self.leases.getValue((lease,))[0] if self.leases.containsKey((lease,)) else ()
        before = {k: tuple(self.jobs.getValue((k,))) for k in ids}
        jobs = Jobs(before.items())
        out = list(expired(jobs, lease + 1))
        self._keep(before, jobs)
        if ids:
            self.leases.removeKey((lease,))
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def claims(log: DataFrame, lease_ms: int, until_ms: int | None = None) -> DataFrame:
    """CLAIMS of a whole log (LOG): what became of each event, and each lease that ran out before a later event of its queue or until_ms."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        jobs, out = Jobs(), []
        for e in (e for events in _events(pdf) for e in events):
            out += step(jobs, e, lease_ms)
        if until_ms is not None:
            out += expired(jobs, until_ms)
        return _frame(pdf["queue"].iloc[0], out)

    return log.groupBy("queue").applyInPandas(run, CLAIMS)


def live_claims(stream: DataFrame, lease_ms: int, at: str = "at", late: str = "10 seconds") -> DataFrame:
    """The same over a stream of LOG and an event time; a lease that runs out is given back once the watermark is past it.

    A queue is one key, as its oldest job is the one to be claimed; many queues are many tasks.
    """
    rows = stream.withWatermark(at, late)
    return _stateful(rows, ["queue"], _Queue(lease_ms), CLAIMS, "EventTime")
