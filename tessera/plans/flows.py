"""Streams, publications, page reading and scoring in rounds on the provided tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import callouts as C
from tessera.operators import lines as W
from tessera.plans.documents import LI, _items
from tessera.plans.relational import SQL as RELATIONAL
from tessera.sources.tables import table
from tessera.store import shared_folder
from tessera.streaming import live, publication

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern takes one file as well as a folder of them."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def arrived(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there, from a written table."""
    root = shared_folder(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


@query(RELATIONAL["rate_limit_window"])
def live_rate_limit(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    got = arrived(live.admitted(e, "user_id", "ts", "event_id", 2), "admitted")
    return got.select("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("window_start"), "n", "event_id")


@query("""WITH d AS (SELECT user_id, min(event_id) AS done FROM events WHERE event_type = 'purchase' AND event_id > 500 GROUP BY user_id)
SELECT user_id, max(event_id) AS event_id FROM events LEFT JOIN d USING (user_id) WHERE event_id > 500 AND (done IS NULL OR event_id <= done) GROUP BY user_id""")
def live_latest(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "succeeded").otherwise("running")
    got = arrived(live.progress(events(spark, sf_dir).select("user_id", "event_id", status.alias("status")), "user_id", "event_id", "status", last_seen=500), "progress")
    return got.select("user_id", "event_id")


def queue_log(e: DataFrame) -> DataFrame:
    """A queue's log made of events: a queue for each 16th user, and seven kinds of event for jobs named by the events before."""
    i = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("submit", "submit", "claim", "heartbeat", "succeed", "claim", "fail")]), (i % 7).cast("int"))
    job = F.concat(F.lit("j"), i - F.when(i % 7 < 2, 0).otherwise(i % 7 * 16))
    ms = F.lit(1_700_000_000_000) + i.cast("long") * 1000
    return e.select(
        F.concat(F.lit("q"), F.col("user_id") % 16).alias("queue"), i.cast("long").alias("seq"), ms.alias("ms"), kind.alias("event"), F.when(kind != "claim", job).alias("job_id"), F.concat(F.lit("w"), F.col("user_id") % 3).alias("worker"),
        F.concat(job, F.lit(":1")).alias("token"), F.timestamp_millis(ms).alias("at"),
    )


@query()
def queue_claims(spark, sf_dir):
    return arrived(live.live_claims(queue_log(events(spark, sf_dir)), 60_000), "claims")


@query("""SELECT o_orderkey AS artifact_id, o_custkey AS source_id, r = 1 AS is_active, r = 2 AS is_rollback FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r < 3""")
def publication_batches(spark, sf_dir):
    """Three batches, of which the second comes twice, and once more with other rows under its number."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("artifact_id"), F.lit("complete").alias("disposition"), F.col("o_orderdate").alias("ready_at"), F.lit("k").alias("object_key"),
    )
    root = shared_folder(spark, "published")
    commit = publication.sink(root, publication.published)
    for epoch, part in ((0, 0), (1, 1), (1, 1), (1, 0), (2, 2)):
        commit(o.where(F.col("artifact_id") % 3 == part), epoch)
    return publication.versions(spark, root).where("is_active or is_rollback").select("artifact_id", "source_id", "is_active", "is_rollback")


@query("""SELECT 'doc_' || doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'Imported document' ELSE lang END AS title, CAST(doc_id % 3 AS BIGINT) AS marks FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 3 <> 0 OR doc_id % 2 = 0)""")
def import_tables(spark, sf_dir):
    k = F.col("doc_id")
    mark = lambda i: F.struct(F.concat(F.lit("line_"), i.cast("string")).alias("entry_id"), F.lit("x").alias("label"), F.lit(None).cast("string").alias("color"))
    batch = table(spark, sf_dir, "documents").select(
        k.cast("string").alias("import_id"), F.col("source").alias("owner_id"), F.when(k % 4 == 0, "committed").otherwise("analyzed").alias("status"), (k % 3 == 0).alias("needs_migration"), (k % 2 == 0).alias("confirmed"),
        F.when(k % 5 == 0, "").otherwise(F.col("lang")).alias("title"), F.sha2("text", 256).alias("sha256"), F.lit("grant").alias("doc_type"), F.lit("k").alias("object_key"), F.lit(1).alias("committed_at"),
        F.when(k % 3 == 0, F.array().cast("array<struct<entry_id:string,label:string,color:string>>")).otherwise(F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), mark)).alias("bookmarks"),
    )
    root = shared_folder(spark, "imported")
    commit = publication.sink(root, publication.imported)
    commit(batch, 0)
    commit(batch, 0)
    marks = publication.committed(spark, root, "bookmarks").groupBy("document_id").agg(F.count("*").alias("marks"))
    return publication.committed(spark, root, "documents").join(marks, "document_id", "left").select("document_id", "title", F.coalesce("marks", F.lit(0)).alias("marks"))


@query(f"""WITH {LI}, r AS (SELECT l_orderkey AS d, l_linenumber AS p, l_partkey % 9 + 1 AS n, CAST(l_quantity AS DOUBLE) / 50 AS s, l_suppkey % 2 = 0 AS spec, l_linenumber % 3 = 1 AS ins FROM li),
a AS (SELECT *, max(CASE WHEN ins THEN n END) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN ins THEN n END) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM r),
o AS (SELECT *, greatest(0, coalesce(CASE WHEN n < b THEN b - n END, 0), coalesce(CASE WHEN n > f THEN n - f END, 0)) AS off FROM a),
c AS (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), s + CASE WHEN ins THEN CAST(0.04 AS DOUBLE) WHEN off <= 2 THEN CAST(-0.04 AS DOUBLE) ELSE CAST(-0.2 AS DOUBLE) END)) AS v FROM o),
h AS (SELECT *, bool_or(ins) OVER (PARTITION BY d, n) AS g FROM c WHERE v >= CASE WHEN spec THEN CAST(0.34 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END)
SELECT d AS doc_id, CAST(p AS INTEGER) AS page_index, CAST(n AS VARCHAR) AS figure_id, round(v, 3) AS score FROM h WHERE NOT g OR ins""")
def figure_rescoring(spark, sf_dir):
    f = _items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_index"), (F.col("l_partkey") % 9 + 1).cast("string").alias("figure_id"), (F.col("l_quantity").cast("double") / 50).alias("score"),
        F.when(F.col("l_suppkey") % 2 == 0, "spec_exact").otherwise("drawing_only").alias("method"), (F.col("l_linenumber") % 3 == 1).alias("in_sequence"),
    )
    return C.rescored_figures(f).select("doc_id", "page_index", "figure_id", "score")


@query("""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS k FROM lineitem),
w AS (SELECT l_suppkey AS d, k // 20 AS p, k % 20 + 1 AS j, 'w' || l_partkey || ' q' || CAST(l_quantity AS INTEGER) AS a, 'r' || l_linenumber AS b FROM r),
pages AS (SELECT d, p, CASE WHEN (d * 7 + p) % 3 = 0 THEN (d + p * 5) % 40 * 2 + 1 END AS own FROM (SELECT DISTINCT d, p FROM w)),
c AS (SELECT d, p, coalesce(own, 1) AS l FROM pages WHERE p = 0 UNION ALL SELECT n.d, n.p, greatest(coalesce(n.own, 0), c.l + 2) FROM c JOIN pages n ON n.d = c.d AND n.p = c.p + 1),
e AS (SELECT d, p, j, 0 AS side, a AS t FROM w UNION ALL SELECT d, p, j, 1, b FROM w)
SELECT d AS doc_id, CAST(p AS INTEGER) AS page_index, CAST(row_number() OVER (PARTITION BY d ORDER BY p, side, j) - 1 AS INTEGER) AS ordinal, CAST(l + side AS INTEGER) AS "column", CAST(j AS INTEGER) AS printed_line, t AS source_text FROM e JOIN c USING (d, p)""")
def grant_lines(spark, sf_dir):
    """Two-column pages made of a supplier's line items, 20 lines each, with line numbers between the columns and a column pair over a third of the pages."""
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_linenumber", n.alias("k"))
    r = r.select(F.col("l_suppkey").alias("doc_id"), F.floor(F.col("k") / 20).cast("int").alias("page_index"), (F.col("k") % 20).alias("j"), "l_partkey", "q", "l_linenumber")

    def word(ix, text, x0, x1, y):
        return F.struct(ix.cast("int").alias("word_ix"), text.alias("text"), F.lit(x0).alias("x0"), (y - 0.008).alias("y0"), F.lit(x1).alias("x1"), (y + 0.008).alias("y1"))

    j = F.col("j")
    y = 0.11 + j * 0.025
    body = F.array(word(j * 3 + 10, F.concat(F.lit("w"), "l_partkey"), 0.12, 0.30, y), word(j * 3 + 11, F.concat(F.lit("q"), "q"), 0.32, 0.44, y), word(j * 3 + 12, F.concat(F.lit("r"), "l_linenumber"), 0.55, 0.72, y))
    page, doc = F.col("page_index"), F.col("doc_id")
    left = (doc + page * 5) % 40 * 2 + 1
    marks = [word(F.lit(100 + i), F.lit(str(i)), 0.49, 0.51, F.lit(0.085 + 0.025 * i)) for i in (5, 10, 15)]
    head = [word(F.lit(i), (left + i).cast("string"), x, x + 0.02, F.lit(0.0535)) for i, x in ((0, 0.28), (1, 0.70))]
    frame = F.when((doc * 7 + page) % 3 == 0, F.array(*marks, *head)).otherwise(F.array(*marks))
    words = r.select(*W.PAGE, F.explode(body).alias("w")).unionByName(r.where("j = 0").select(*W.PAGE, F.explode(frame).alias("w")))
    got = W.grant_entries(words.select(*W.PAGE, "w.*", F.lit(None).cast("double").alias("confidence")))
    return got.select("doc_id", "page_index", "ordinal", "column", "printed_line", "source_text")
