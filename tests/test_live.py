"""Streams against the batch forms of the same log, over restarts and repeated batches."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.streaming import jobs, live, publication

LEASE = 30_000


def run(df, root, name, **options):
    """Everything that is there now, as a query that starts, or goes on, from its checkpoint; what it has written so far."""
    q = df.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


@pytest.fixture(autouse=True)
def folder(tmp_path):
    (tmp_path / "in").mkdir()


def put(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(at))


def queue_log(rnd, n, queues=("p", "q")):
    """Submissions, claims and what workers then say, some late, with a wrong token or for the wrong job."""
    out, ms = [], 0
    for seq in range(n):
        ms += rnd.choice([0, 500, 4_000, 20_000])
        job = f"j{rnd.randint(0, max(1, seq // 2))}"
        event = rnd.choice(["submit", "submit", "claim", "claim", "heartbeat", "succeed", "fail", "cancel", "stop", "retry"])
        out.append((rnd.choice(queues), seq, ms, event, f"j{seq}" if event == "submit" else None if event == "claim" else job, rnd.choice(["w1", "w2"]), rnd.choice([f"{job}:1", f"{job}:1", f"{job}:2", None])))
    return out


def plain_claims(log, lease, until):
    """One queue at a time, event by event, with a list of jobs."""
    out = []
    for queue in sorted({r[0] for r in log}):
        jobs = []

        def reap(ms):
            for j in sorted((j for j in jobs if j["lease"] is not None and j["lease"] < ms), key=lambda j: (j["lease"], j["id"])):
                j["state"] = "queued" if j["state"] == "running" else "cancelled"
                out.append((queue, None, j["lease"], "expire", j["id"], j["worker"], j["token"], True, j["state"], j["attempt"], None))
                j["lease"] = j["token"] = j["worker"] = None

        for _, seq, ms, event, job, worker, token in (r for r in log if r[0] == queue):
            reap(ms)
            waiting = [j for j in jobs if j["state"] == "queued"]
            j = (waiting[0] if waiting else None) if event == "claim" else next((x for x in jobs if x["id"] == job), None)
            ok = False
            if event == "submit" and j is None:
                j = {"id": job, "state": "queued", "attempt": 0, "worker": None, "token": None, "lease": None}
                jobs.append(j)
                ok = True
            elif event == "claim" and j:
                j.update(state="running", attempt=j["attempt"] + 1, worker=worker, lease=ms + lease)
                j["token"] = f"{j['id']}:{j['attempt']}"
                ok = True
            elif j and event in ("heartbeat", "succeed", "fail", "stop"):
                ok = j["state"] in ("running", "cancelling") and j["token"] is not None and token == j["token"] and (event != "stop" or j["state"] == "cancelling")
                if ok and event == "heartbeat":
                    j["lease"] = ms + lease
                elif ok:
                    j.update(state={"succeed": "succeeded", "fail": "failed", "stop": "cancelled"}[event], token=None, lease=None)
            elif j and event == "cancel" and j["state"] in ("queued", "running"):
                j["state"] = "cancelled" if j["state"] == "queued" else "cancelling"
                ok = True
            elif j and event == "retry" and j["state"] in ("failed", "cancelled"):
                j.update(state="queued", worker=None, token=None, lease=None)
                ok = True
            out.append((queue, seq, ms, event, j["id"] if j else job, worker, j["token"] if j else None, ok, j["state"] if j else None, j["attempt"] if j else None, j["lease"] if j else None))
        reap(until)
    return sorted(out, key=repr)


def test_claims_and_leases(spark, tmp_path):
    """The stream, cut into files with a restart and a replayed file between, gives what the whole log gives."""
    log = queue_log(random.Random(4), 400)
    end = log[-1][2]
    want = plain_claims(log, LEASE, end + 10 * LEASE)
    whole = spark.createDataFrame(log, live.LOG)
    assert sorted(map(tuple, live.claims(whole, LEASE, end + 10 * LEASE).collect()), key=repr) == want
    assert {"expire"} < {r[3] for r in want if r[7]} and any(not r[7] for r in want)

    schema = live.LOG + ", at timestamp"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = live.live_claims(s, LEASE)
    at = F.timestamp_millis("ms").alias("at")
    tick = spark.createDataFrame([("clock", 0, end + 12 * LEASE, "tick", None, None, None)], live.LOG)  # another queue's event moves the watermark
    for part in (whole.where("seq < 150"), whole.where("seq >= 100 and seq < 300"), whole.where("seq >= 300"), tick, tick):
        part.select("*", at).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = run(stream, tmp_path, "claims")
    assert sorted((tuple(r) for r in got.where("queue <> 'clock'").collect()), key=repr) == want


def test_admissions(spark, tmp_path):
    rnd = random.Random(1)
    rows = sorted((f"2024-01-01 00:{rnd.randint(0, 20):02d}:{rnd.randint(0, 59):02d}", i, f"k{rnd.randint(0, 3)}") for i in range(600))
    schema = "at timestamp, id int, key string"
    whole = spark.createDataFrame(rows, "at string, id int, key string").select(F.col("at").cast("timestamp").alias("at"), "id", "key")
    want = {(r["id"], r["n"]) for r in jobs.rate_limited(whole, "key", "at", "id", 4).collect()}
    stream = live.admitted(spark.readStream.schema(schema).json(str(tmp_path / "in")), "key", "at", "id", 4, "1 minute")
    for a, b in ((0, 250), (250, 260), (260, 600)):  # the cuts lie within minutes
        whole.where(F.col("id").isin([r[1] for r in rows[a:b]])).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = run(stream, tmp_path, "admitted")
    assert {(r["id"], r["n"]) for r in got.collect()} == want and got.count() == len(want)


def test_progress_ends_and_goes_on(spark, tmp_path):
    schema = "job string, seq long, status string"
    stream = live.progress(spark.readStream.schema(schema).json(str(tmp_path / "in")), "job", "seq", "status", last_seen=1)
    shown = []
    for rows in ([("a", 1, "running"), ("a", 2, "running"), ("a", 3, "running"), ("b", 1, "queued")], [("a", 3, "running"), ("b", 2, "running")], [("a", 4, "running"), ("a", 5, "succeeded"), ("a", 6, "running")], [("a", 7, "running"), ("b", 3, "failed")], [("b", 3, "failed")]):
        put(spark, rows, schema, tmp_path / "in")
        now = sorted(tuple(r) for r in run(stream, tmp_path, "shown").collect())
        shown.append([x for x in now if x not in sum(shown, [])])
    assert shown == [[("a", 3, "running")], [("b", 2, "running")], [("a", 5, "succeeded")], [("b", 3, "failed")], []]


BATCH = "document_id string, source_id string, artifact_id string, disposition string, ready_at long, object_key string"


def test_a_batch_is_published_once(spark, tmp_path):
    root = str(tmp_path / "store")
    commit = publication.sink(root, publication.published)
    one = spark.createDataFrame([("d1", "s1", "a1", "complete", 1, "k1"), ("d2", "s2", "a2", "partial", 1, "k2")], BATCH)
    two = spark.createDataFrame([("d1", "s1", "a3", "complete_with_warnings", 2, "k3")], BATCH)
    three = spark.createDataFrame([("d1", "s1", "a4", "complete", 3, "k4")], BATCH)
    commit(one, 0)

    def torn(batch):
        made = publication.published(batch)
        return {"artifacts": made["artifacts"], "documents": made["documents"].select(F.raise_error(F.lit("executor lost")).alias("x"))}

    with pytest.raises(Exception, match="executor lost"):
        publication.sink(root, torn)(two, 1)
    assert {r["artifact_id"] for r in publication.versions(spark, root).collect()} == {"a1", "a2"}  # half a batch is not seen
    commit(two, 1)
    commit(two, 1)
    commit(three, 1)  # the epoch is taken: nothing changes
    commit(three, 2)
    got = {(r["artifact_id"], r["is_active"], r["is_rollback"]) for r in publication.versions(spark, root).collect()}
    assert got == {("a1", False, False), ("a3", False, True), ("a4", True, False), ("a2", True, False)}
    docs = publication.committed(spark, root, "documents")
    last = L.latest_per(docs, ["document_id"], [F.desc("ready_at")])
    assert {(r["document_id"], r["active_artifact_id"], r["state"]) for r in last.collect()} == {("d1", "a4", "ready"), ("d2", "a2", "ready_with_warnings")}


def test_imports_fill_all_tables_or_none(spark, tmp_path):
    schema = "import_id string, owner_id string, status string, needs_migration boolean, confirmed boolean, title string, sha256 string, doc_type string, object_key string, committed_at long, bookmarks array<struct<entry_id:string,label:string,color:string>>"
    rows = [
        ("1", "o", "analyzed", False, False, "", "h", "grant", "k", 5, [("e1", "x", None), ("e2", None, "red")]), ("2", "o", "committed", False, False, "t", "h", "grant", "k", 5, [("e1", "x", None)]),
        ("3", "o", "analyzed", True, False, "t", "h", "grant", "k", 5, [("e1", "x", None)]), ("4", "p", "analyzed", True, True, "t", None, "application", "k", 5, []),
    ]
    root = str(tmp_path / "store")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        s = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = s.writeStream.foreachBatch(publication.sink(root, publication.imported)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    n = {t: publication.committed(spark, root, t).count() for t in ("sources", "artifacts", "documents", "bookmarks", "audit")}
    assert n == {"sources": 2, "artifacts": 2, "documents": 2, "bookmarks": 2, "audit": 2}
    assert {r["title"] for r in publication.committed(spark, root, "documents").collect()} == {"Imported document", "t"}


def test_clones_live_by_themselves(spark):
    have = spark.createDataFrame([("a1", "s1", "c", "k1", 1, "complete"), ("a2", "s1", "c", "k2", 2, "partial")], "artifact_id string, source_id string, config_hash string, object_key string, ready_at long, disposition string")
    src = spark.createDataFrame([("s1", "o", "h"), ("s2", "p", "h")], "source_id string, owner_id string, sha256 string")
    asks = spark.createDataFrame([("d9", "s9", "h", "c", "a9", 7), ("d8", "s8", "other", "c", "a8", 7)], "document_id string, source_id string, sha256 string, config_hash string, artifact_id string, ready_at long")
    got = [tuple(r) for r in publication.cloned(have, src, asks, "o").collect()]
    assert got == [("d9", "s9", "a9", "complete", 7, "artifacts/o/a9", "k1")]


def test_a_queue_of_many_jobs_takes_time_in_proportion():
    n = 30_000
    log = [{"seq": i, "ms": i, "event": "submit", "job_id": f"j{i}", "worker": None, "token": None} for i in range(n)]
    log += [{"seq": n + i, "ms": n + i, "event": "claim", "job_id": None, "worker": "w", "token": None} for i in range(n)]
    jobs, began = live.Jobs(), time.process_time()
    got = [r for e in log for r in live.step(jobs, e, 10_000)]
    assert time.process_time() - began < 30  # looking at all jobs for each claim took minutes
    assert [r[3] for r in got if r[2] == "claim"][:10_000] == [f"j{i}" for i in range(10_000)] and [r[3] for r in got if r[2] == "expire"][:2] == ["j0", "j1"]


def test_open_minutes_are_one_value():
    """One write of state and one timer for a key's batch, however many minutes it has."""
    calls = []

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def getValueState(self, *args):
            return State()

        def registerTimer(self, at):
            calls.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    limiter = live._Limiter("id", 2)
    limiter.init(Handle())
    rows = pd.DataFrame({"id": range(300), "limit_ms": [i // 3 * live.MINUTE for i in range(300)], "limit_at": None})
    (out,) = limiter.handleInputRows(("a",), iter([rows]), Times())
    assert len(out) == 200 and calls == ["update", 100 * live.MINUTE] and len(limiter._open(40 * live.MINUTE)) == 60
