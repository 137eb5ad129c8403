"""Library, queue and scoring operators on the provided tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import library as L
from tessera.operators import metrics as M
from tessera.operators.near import near_texts
from tessera.sources.tables import table
from tessera.streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tasks that the pairs of one name are dealt over.
DEALT = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT source, count(*) AS hits, CAST(sum(len(string_split(lower(text), 'the ')) - 1) AS BIGINT) AS snippets, min(doc_id) AS first_doc
FROM documents WHERE contains(lower(text), 'the ') GROUP BY source""")
def kw_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hit = F.contains(F.lower("text"), F.lit("the "))
    return d.where(hit).groupBy("source").agg(F.count("*").alias("hits"), F.sum(F.size(F.split(F.lower("text"), "the ", -1)) - 1).alias("snippets"), F.min("doc_id").alias("first_doc"))


@query("""WITH h AS (SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion')), s AS (SELECT h.* FROM h SEMI JOIN labels USING (doc_id))
SELECT doc_id, source FROM s UNION ALL SELECT doc_id, source FROM h WHERE (SELECT count(*) FROM s) = 0""")
def kw_search_scoped(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return L.search(d, table(spark, sf_dir, "labels"), T.contains_text(F.col("text"), "tion"), "doc_id").select("doc_id", "source")


@query("""SELECT o_orderkey, c_name, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderstatus <> 'F' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey""")
def library_list(spark, sf_dir):
    mine = L.owned(table(spark, sf_dir, "customer"), "c_nationkey", 7).select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(mine, F.col("o_custkey") == F.col("c_custkey"))
    return o.orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "c_name", "o_totalprice", "o_orderpriority")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IS NOT DISTINCT FROM 2""")
def workspace_filter(spark, sf_dir):
    return L.in_workspace(table(spark, sf_dir, "nation"), "n_regionkey", 2).select("n_nationkey", "n_name")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_parent(spark, sf_dir):
    return L.latest_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_JOBS = """jobs AS (SELECT event_id AS job_id, ts AS created_at, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status,
CASE WHEN event_id % 8 = 1 THEN ts + INTERVAL 30 SECOND END AS lease_until, CAST(event_id % 3 AS INTEGER) AS attempt, CAST(user_id % 5 AS INTEGER) AS fence FROM events)"""


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.when(i % 4 == 0, "queued").when(i % 4 == 1, "running").when(i % 4 == 2, "succeeded").otherwise("failed")
    return e.select(i.alias("job_id"), F.col("ts").alias("created_at"), status.alias("status"), F.when(i % 8 == 1, F.col("ts") + F.expr("INTERVAL 30 SECOND")).alias("lease_until"), (i % 3).cast("int").alias("attempt"), (F.col("user_id") % 5).cast("int").alias("fence"))


NOW = "2024-01-15 00:00:00"


@query(f"""WITH {_JOBS} SELECT job_id, 'running' AS status, attempt + 1 AS attempt, fence + 1 AS fence FROM jobs
WHERE status = 'queued' OR (status = 'running' AND lease_until < TIMESTAMP '{NOW}') ORDER BY created_at, job_id LIMIT 1""")
def claim_next(spark, sf_dir):
    return L.next_claim(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("job_id", "status", "attempt", "fence")


@query(f"""WITH {_JOBS}, r AS (SELECT job_id, coalesce(status = 'running' AND lease_until < TIMESTAMP '{NOW}', false) AS late, status, lease_until FROM jobs)
SELECT job_id, CASE WHEN late THEN 'queued' ELSE status END AS status, lease_until IS NOT NULL AND NOT late AS leased FROM r""")
def reap_expired(spark, sf_dir):
    return L.reaped(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("job_id", "status", F.col("lease_until").isNotNull().alias("leased"))


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS requests, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS scans,
CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END), 0) AS BIGINT) AS tokens,
max(CASE WHEN event_type = 'purchase' THEN event_id END) AS last_used FROM events GROUP BY user_id""")
def usage_rollup(spark, sf_dir):
    kind = F.col("event_type")
    return L.usage(table(spark, sf_dir, "events"), ["user_id"], {"requests": kind == "purchase", "scans": kind == "signup"}, {"tokens": "$.k"}, "props", "event_id", kind == "purchase")


@query("""WITH n AS (SELECT *, CASE WHEN n_nationkey % 6 = 5 THEN NULL WHEN n_regionkey = 3 THEN 2 ELSE n_regionkey END AS ws FROM nation)
SELECT r_name AS bucket, count(n_nationkey) AS n FROM region LEFT JOIN n ON ws = r_regionkey GROUP BY r_name UNION ALL SELECT 'Unfiled', count(*) FROM n WHERE ws IS NULL""")
def workspace_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("r_regionkey", F.when(F.col("n_nationkey") % 6 == 5, F.lit(None)).when(F.col("n_regionkey") == 3, 2).otherwise(F.col("n_regionkey")))
    return L.grouped_with_unfiled(table(spark, sf_dir, "region"), n, "r_regionkey", "r_name")


@query("""WITH p AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation),
m AS (SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 1 ELSE n_regionkey END AS grp, CASE WHEN n_nationkey = 7 THEN 1.5 ELSE pos END AS place FROM p)
SELECT n_nationkey, grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY place, n_nationkey) - 1 AS INTEGER) AS pos FROM m""")
def placement_renumber(spark, sf_dir):
    w = Window.partitionBy("grp").orderBy("n_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("grp")).withColumn("pos", F.row_number().over(w) - 1)
    return L.placed_before(n, "grp", "pos", "n_nationkey", 7, 2, 1)


@query("""WITH a AS (SELECT doc_id, sha256(text) AS sha, source FROM documents WHERE text IS NOT NULL AND lang IN ('en', 'fr'))
SELECT sha, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC) AS n FROM a) WHERE n = 1""")
def reusable_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("lang").isin("en", "fr"))
    return L.latest_per(d.select("doc_id", F.sha2("text", 256).alias("sha")), ["sha"], [F.desc("doc_id")]).select("sha", "doc_id")


@query("""WITH d AS (SELECT l_suppkey AS source_id, l_orderkey % 50 = 0 AS doomed FROM lineitem)
SELECT source_id, bool_or(NOT doomed) AS shared FROM d GROUP BY source_id HAVING bool_or(doomed)""")
def shared_source_purge(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("document_id"), F.col("l_suppkey").alias("source_id"))
    return L.purge_plan(d, d.where(F.col("document_id.l_orderkey") % 50 == 0))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER w = 1 AS is_active, row_number() OVER w = 2 AS is_rollback FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC)""")
def publish_active(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_shipdate").alias("ready_at"), F.col("l_linenumber").alias("artifact_id"))
    return L.active_version(a).select(F.col("source_id").alias("l_orderkey"), F.col("artifact_id").alias("l_linenumber"), "is_active", "is_rollback")


@query("""SELECT user_id, (SELECT value FROM events e WHERE e.user_id = u.user_id AND event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 1) AS value FROM (SELECT DISTINCT user_id FROM events) u""")
def partial_update(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return L.latest_state(e, ["user_id"], ["value"], ["ts", "event_id"])


@query("""WITH w AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE s_nationkey END AS workspace_id FROM w JOIN nation ON n_nationkey = s_nationkey""")
def unfile_on_delete(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("workspace_id"))
    return L.unfiled_on_delete(s, table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("workspace_id")))


@query("""WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c, source FROM documents)
SELECT source, doc_id FROM r WHERE c <= 5 OR i IN (SELECT CAST(floor(j * c / 5.0) AS BIGINT) FROM range(5) t(j))""")
def even_sample(spark, sf_dir):
    return L.evenly_sampled(table(spark, sf_dir, "documents"), ["doc_id"], 5, ["source"]).select("source", "doc_id")


@query("""SELECT source, CAST(sum(quality) AS BIGINT) AS num, count(*) AS den, sum(quality) / nullif(count(*), 0) AS ratio FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def ratio_pooled(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("source").agg(F.sum("quality").alias("num"), F.count("*").alias("den"), M.pooled(F.col("quality"), F.lit(1)).alias("ratio"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CAST(l_suppkey % 3 AS INTEGER) AS "column", CAST(l_partkey % 60 AS INTEGER) AS line FROM lineitem WHERE l_linenumber < 6),
e AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CAST((l_suppkey + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) % 3 AS INTEGER) AS gc, CAST(l_partkey % 60 + l_orderkey % 3 AS INTEGER) AS gl FROM lineitem WHERE l_linenumber <> 2)
SELECT doc_id, count(*) AS den, CAST(count(*) FILTER ("column" = gc AND line = gl) AS BIGINT) AS exact, CAST(count(*) FILTER ("column" = gc AND abs(line - gl) <= 1) AS BIGINT) AS within_one FROM l LEFT JOIN e USING (doc_id, ordinal) GROUP BY doc_id""")
def reference_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), "l_suppkey", "l_partkey")
    want = li.where("ordinal < 6").select("doc_id", "ordinal", (F.col("l_suppkey") % 3).cast("int").alias("column"), (F.col("l_partkey") % 60).cast("int").alias("line"))
    got = li.where("ordinal <> 2").select("doc_id", "ordinal", ((F.col("l_suppkey") + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)) % 3).cast("int").alias("column"), (F.col("l_partkey") % 60 + F.col("doc_id") % 3).cast("int").alias("line"))
    return M.reference_score(want, got)


_BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS ax0, l_discount AS ay0, l_quantity / 100 + 0.25 AS ax1, l_discount + 0.5 AS ay1, l_tax * 4 AS bx0, l_tax AS by0, l_tax * 4 + 0.5 AS bx1, l_tax + 0.25 AS by1 FROM lineitem),
i AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0.0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0.0) AS inter, (ax1 - ax0) * (ay1 - ay0) AS a, (bx1 - bx0) * (by1 - by0) AS b FROM b),
u AS (SELECT *, CASE WHEN inter > 0 AND a + b - inter > 0 THEN inter / (a + b - inter) ELSE 0.0 END AS iou FROM i)"""


def _boxes(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    a, b = G.box(q / 100, d, q / 100 + 0.25, d + 0.5), G.box(t * 4, t, t * 4 + 0.5, t + 0.25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


@query(f"""WITH {_BOXES} SELECT l_orderkey, l_linenumber, round(iou, 9) AS iou, round(inter / least(a, b), 9) AS part FROM u""")
def box_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(G.iou(F.col("a"), F.col("b")), 9).alias("iou"), F.round(G.containment(F.col("a"), F.col("b")), 9).alias("part"))


@query(f"""WITH {_BOXES} SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, round(median(iou), 9) AS median_iou FROM u GROUP BY 1""")
def iou_median(spark, sf_dir):
    from tessera.operators.rounds import exact_median

    each = _boxes(spark, sf_dir).select("l_linenumber", G.iou(F.col("a"), F.col("b")).alias("iou"))
    return exact_median(each, ["l_linenumber"], "iou").select("l_linenumber", F.round("median", 9).alias("median_iou"))


@query("""WITH g(name, threshold, up) AS (VALUES ('reference_exact', 0.985, true), ('reference_within_one', 0.995, true), ('callout_precision', 0.98, true), ('callout_recall', 0.95, true), ('association_precision', 0.99, true), ('silent_verified_on_ambiguous', 0.0, false), ('substitution_rejection', 1.0, true), ('median_box_iou', 0.85, true)),
m AS (SELECT 'reference_exact' AS name, sum(quality) / count(*) AS value FROM labels UNION ALL SELECT 'silent_verified_on_ambiguous', sum(toxic) * 0.0 FROM labels UNION ALL SELECT 'callout_recall', 1 - sum(toxic) / count(*) FROM labels)
SELECT name, value, CAST(threshold AS DOUBLE) AS threshold, value IS NOT NULL AS applicable, CASE WHEN value IS NULL THEN true WHEN up THEN value >= threshold ELSE value <= threshold END AS passed FROM g LEFT JOIN m USING (name)""")
def gate_table(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    one = lambda name, c: lab.agg(c.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    n = F.count("*")
    return M.gates(one("reference_exact", F.sum("quality") / n).union(one("silent_verified_on_ambiguous", F.sum("toxic") * 0.0)).union(one("callout_recall", 1 - F.sum("toxic") / n)))


@query("""WITH t(min_ratio) AS (VALUES (0.5), (0.72), (0.8), (0.9), (0.95)), l AS (SELECT (doc_id * 37 % 100) / 100.0 AS ratio, quality = 1 AS r FROM labels)
SELECT CAST(min_ratio AS DOUBLE) AS min_ratio, count(*) FILTER (ratio >= min_ratio AND r) / nullif(count(*) FILTER (r), 0) AS coverage, count(*) FILTER (ratio < min_ratio AND NOT r) / nullif(count(*) FILTER (NOT r), 0) AS rejection FROM l, t GROUP BY min_ratio""")
def threshold_sweep(spark, sf_dir):
    return M.sweep(table(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 100) / 100.0).alias("ratio"), (F.col("quality") == 1).alias("right")), [0.5, 0.72, 0.8, 0.9, 0.95])


@query("""WITH t(min_ratio) AS (VALUES (0.5), (0.72), (0.8), (0.9), (0.95)), l AS (SELECT (doc_id * 37 % 80) / 100.0 AS ratio, quality = 1 AS r FROM labels),
s AS (SELECT min_ratio, count(*) FILTER (ratio < min_ratio AND NOT r) / nullif(count(*) FILTER (NOT r), 0) AS rejection FROM l, t GROUP BY min_ratio)
SELECT CAST(min(min_ratio) FILTER (rejection >= 1) AS DOUBLE) AS min_ratio FROM s""")
def recommended_threshold(spark, sf_dir):
    return M.recommended(M.sweep(table(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 80) / 100.0).alias("ratio"), (F.col("quality") == 1).alias("right")), [0.5, 0.72, 0.8, 0.9, 0.95]))


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS ordinal FROM conversations""")
def ordinal_assign(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("ordinal"))


@query("""SELECT l_orderkey, l_linenumber, max(CAST(l_partkey % 60 AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS printed FROM lineitem""")
def running_max_line(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.max((F.col("l_partkey") % 60).cast("int")).over(w).alias("printed"))


@query("""WITH m AS (SELECT *, median(s_acctbal) OVER (PARTITION BY s_nationkey) AS med, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier) SELECT s_suppkey, s_nationkey FROM m WHERE c < 3 OR abs(s_acctbal - med) <= 2500""")
def outlier_filter(spark, sf_dir):
    w = Window.partitionBy("s_nationkey")
    s = table(spark, sf_dir, "supplier").withColumns({"m": F.median("s_acctbal").over(w), "c": F.count("*").over(w)})
    return s.where((F.col("c") < 3) | (F.abs(F.col("s_acctbal") - F.col("m")) <= 2500)).select("s_suppkey", "s_nationkey")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 * 5 - lag(l_partkey % 5 * 5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS step FROM lineitem),
c AS (SELECT l_orderkey, step, count(*) AS n, min(l_linenumber) AS f FROM d WHERE step > 0 GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey FROM lineitem),
b AS (SELECT l_orderkey, step FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f, step) AS k FROM c) WHERE k = 1) SELECT l_orderkey, coalesce(step, 5) AS step FROM o LEFT JOIN b USING (l_orderkey)""")
def step_mode(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    v = F.col("l_partkey") % 5 * 5
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (v - F.lag(v).over(w)).alias("step"))
    c = li.where("step > 0").groupBy("l_orderkey", "step").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("f"))
    best = L.latest_per(c, ["l_orderkey"], [F.desc("n"), F.col("f"), F.col("step")]).select("l_orderkey", "step")
    return li.select("l_orderkey").distinct().join(best, "l_orderkey", "left").select("l_orderkey", F.coalesce("step", F.lit(5)).alias("step"))


@query("""SELECT user_id, window_start, CAST(n AS INTEGER) AS n, event_id FROM (SELECT user_id, date_trunc('minute', ts) AS window_start, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS n, event_id FROM events) WHERE n <= 2""")
def rate_limit_window(spark, sf_dir):
    got = J.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2)
    return got.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "event_id")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id > 500) WHERE n = 1""")
def progress_latest(spark, sf_dir):
    return J.snapshots(table(spark, sf_dir, "events"), "user_id", "event_id", 500).select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN r = 1 OR event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sequence FROM s""")
def progress_dedupe(spark, sf_dir):
    return J.progress_sequence(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], ["ts", "event_id"]).select("user_id", "event_id", "sequence")


@query("""WITH e AS (SELECT user_id, event_id, value % 3 AS token, event_type FROM events), m AS (SELECT user_id, max(event_id % 7) AS fence FROM events GROUP BY user_id),
t AS (SELECT event_id, e.user_id, event_type FROM events e JOIN m ON e.user_id = m.user_id AND e.event_id % 7 = m.fence),
f AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS done FROM t GROUP BY user_id)
SELECT t.user_id, t.event_id, t.event_type FROM t JOIN f USING (user_id) WHERE done IS NULL OR t.event_id <= done""")
def fenced_writes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("fence", F.col("event_id") % 7)
    return J.fenced(e, "user_id", "fence", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "event_type")


@query("""SELECT p.page_id FROM pages p ANTI JOIN (SELECT page_id FROM pages WHERE page_id % 3 = 0) c USING (page_id)""")
def resume_missing(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("k1").alias("cache_key"))
    return J.to_compute(p, p.where("page_id % 3 = 0"), ["page_id"]).select("page_id")


@query("""SELECT b1.p_brand AS p_brand, b1.p_partkey AS a, b2.p_partkey AS b, CAST(levenshtein(b1.p_name, b2.p_name) AS INTEGER) AS distance FROM part b1 JOIN part b2 ON b1.p_partkey < b2.p_partkey WHERE levenshtein(b1.p_name, b2.p_name) <= 4""")
def edit_distance_pairs(spark, sf_dir):
    """All pairs of parts whose names are at most four edits apart, of whatever brand, size and type; p_brand is that of a."""
    p = table(spark, sf_dir, "part")
    near = near_texts(p.select("p_name"), "p_name", 4)  # each pair of names once, however many parts bear them
    deal = F.pmod(F.xxhash64("p_partkey"), F.lit(DEALT)).cast("int")
    a = p.select("p_brand", F.col("p_partkey").alias("a"), F.col("p_name").alias("p"), deal.alias("deal"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    left = a.join(near, "p").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q", "deal")  # by number: few bytes here give very many pairs
    return left.join(b, ["q", "deal"]).where(F.col("a") < F.col("b")).select("p_brand", "a", "b", "distance")


@query("""SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_comment END AS pick FROM (SELECT *, 'auto' || n_nationkey AS n_comment FROM nation)""")
def override_precedence(spark, sf_dir):
    from tessera.operators.mentions import with_overrides

    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.concat(F.lit("auto"), "n_nationkey").alias("callout_id"))
    o = n.where("n_nationkey % 5 = 0 or n_nationkey % 3 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("callout_id"))
    return with_overrides(n.drop("n_name"), o, ["n_nationkey"]).select("n_regionkey", "n_nationkey", F.col("callout_id").alias("pick"))


@query("""SELECT label, CAST(b AS INTEGER) AS b, count(*) AS n FROM (SELECT label, unnest(range(CAST(floor((embedding[1] + 1) * 30) AS INTEGER), CAST(floor((embedding[1] + 1) * 30) AS INTEGER) + 1 + CAST(floor(abs(embedding[2]) * 10) AS INTEGER))) AS b FROM embeddings) GROUP BY 1, 2""")
def coverage_histogram(spark, sf_dir):
    x, y = F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1))
    lo = F.floor((x + 1) * 30).cast("int")
    e = table(spark, sf_dir, "embeddings").select("label", F.explode(F.sequence(lo, lo + F.floor(F.abs(y) * 10).cast("int"))).alias("b"))
    return e.groupBy("label", "b").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n_words, avg(c) AS mean, count(*) FILTER (c < 50) / count(*) AS low, CAST(sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS BIGINT) AS useful FROM (SELECT source, text, CAST(least(greatest(n_chars % 130 - 10, 0), 100) AS DOUBLE) AS c FROM documents) GROUP BY source""")
def ocr_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "text", (F.col("n_chars") % 130 - 10).cast("double").alias("confidence"))
    return M.ocr_quality(d, ["source"])


@query("""SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'working' ELSE 'other' END AS status FROM orders) GROUP BY status""")
def library_counters(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "working").otherwise("other")
    return table(spark, sf_dir, "orders").groupBy(s.alias("status")).agg(F.count("*").alias("n"))
