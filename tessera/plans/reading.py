"""Viewer, assembly and figure operators on the provided tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import artifacts as A
from tessera.operators import callouts as C
from tessera.operators import figures as FG
from tessera.operators import library as L
from tessera.operators import metrics as M
from tessera.operators import navigation as N
from tessera.operators import records as R
from tessera.operators import view as V
from tessera.plans.documents import _words
from tessera.sources import html as H
from tessera.sources.tables import table
from tessera.streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Line items, one a number of an order.
LI = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount")])


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)tion')) AS BIGINT) AS hits, CAST(length(text) AS BIGINT) AS n FROM documents""")
def highlight_segments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", V.segments(F.col("text"), "tion").alias("s"))
    hits = F.size(F.filter("s", lambda x: x["hit"])).cast("long")
    return d.select("doc_id", hits.alias("hits"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"])).alias("n"))


@query("""WITH s AS (SELECT conv_id AS doc_id, turn, 2 + turn % 3 AS a, 6 + turn % 5 AS b, 'x' AS name FROM conversations WHERE length(text) > 0 UNION ALL SELECT conv_id, turn, 4, 9, 'y' FROM conversations WHERE length(text) > 0),
e AS (SELECT conv_id AS doc_id, turn, length(text) AS n FROM conversations WHERE length(text) > 0), c AS (SELECT doc_id, turn, a AS place FROM s UNION SELECT doc_id, turn, b FROM s UNION SELECT doc_id, turn, 0 FROM e UNION SELECT doc_id, turn, n FROM e),
p AS (SELECT doc_id, turn, place AS "start", lead(place) OVER (PARTITION BY doc_id, turn ORDER BY place) AS "end" FROM c)
SELECT p.doc_id, p.turn, CAST(p."start" AS INTEGER) AS "start", CAST(p."end" AS INTEGER) AS "end", coalesce(string_agg(s.name, ',' ORDER BY s.name), '') AS names FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.turn = p.turn AND s.a <= p."start" AND p."end" <= s.b WHERE p."end" IS NOT NULL GROUP BY 1, 2, 3, 4""")
def mark_intervals(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("length(text) > 0").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    t = F.col("turn")
    one = c.select("doc_id", "turn", (2 + t % 3).cast("int").alias("start"), (6 + t % 5).cast("int").alias("end"), F.lit("x").alias("name"))
    two = c.select("doc_id", "turn", F.lit(4).alias("start"), F.lit(9).alias("end"), F.lit("y").alias("name"))
    return N.marks(c, one.union(two), ["doc_id", "turn"]).select("doc_id", "turn", "start", "end", F.array_join("names", ",").alias("names"))


@query("""WITH p AS (SELECT source AS doc_id, count(*) AS page_count, count(*) FILTER (doc_id % 3 = 0) AS ocr_pages FROM documents GROUP BY source), e AS (SELECT source AS doc_id, count(*) AS entry_count, count(*) FILTER (quality = 1) AS detected_references, count(*) FILTER (quality = 0) AS interpolated_references FROM labels JOIN documents USING (doc_id) GROUP BY source),
l AS (SELECT source AS doc_id, count(*) FILTER (toxic = 1) AS verified_links FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT doc_id, page_count, ocr_pages, coalesce(entry_count, 0) AS entry_count, coalesce(detected_references, 0) AS detected_references, coalesce(interpolated_references, 0) AS interpolated_references, coalesce(verified_links, 0) AS verified_links,
CASE WHEN ocr_pages = 0 THEN 'native' WHEN ocr_pages = page_count THEN 'ocr' ELSE 'hybrid' END AS mode, CASE WHEN coalesce(entry_count, 0) = 0 THEN 'partial' WHEN detected_references = 0 THEN 'complete_with_warnings' ELSE 'complete' END AS disposition FROM p LEFT JOIN e USING (doc_id) LEFT JOIN l USING (doc_id)""")
def quality_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("native").alias("method"), F.lit(False).alias("is_drawing"))
    lab = table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id")
    entries = lab.select(F.col("source").alias("doc_id"), F.when(F.col("quality") == 1, "detected").otherwise("interpolated").alias("reference_method"))
    links = lab.select(F.col("source").alias("doc_id"), F.when(F.col("toxic") == 1, "verified").otherwise("probable").alias("status"))
    none = spark.createDataFrame([], "doc_id string, method string")
    got = A.quality(pages, entries, none, none, none, none, links)
    return got.select("doc_id", "page_count", "ocr_pages", "entry_count", "detected_references", "interpolated_references", "verified_links", "mode", "disposition")


@query(f"""WITH {LI}, r AS (SELECT l_orderkey, l_linenumber, l_quantity / 250 AS x FROM li), b AS (SELECT l_orderkey, quantile_disc(x, 0.2) AS base FROM r GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN greatest(x - base, 0) < 0.006 THEN 0 ELSE least(6, greatest(1, floor(greatest(x - base, 0) / 0.012 + 0.5))) END AS INTEGER) AS indent FROM r JOIN b USING (l_orderkey)""")
def indent_levels(spark, sf_dir):
    e = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 250).alias("left"))
    return N.indent_levels(e, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "indent")


@query(f"""WITH {LI}, r AS (SELECT l_orderkey, l_linenumber, l_linenumber * 0.5 + (l_suppkey % 3) * 0.25 AS y, CAST(l_partkey % 4 = 0 AS INTEGER) AS indent FROM li), g AS (SELECT *, y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM r),
t AS (SELECT l_orderkey, list_sort(list(gap) FILTER (gap > 0)) AS gs FROM g GROUP BY 1), u AS (SELECT l_orderkey, gs[len(gs) // 2 + 1] AS typical FROM t)
SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AND (l_linenumber % 3 = 0 OR indent > 0 OR coalesce(gap >= greatest(0.018, 1.6 * typical), false)) AS starts FROM g LEFT JOIN u USING (l_orderkey)""")
def paragraph_starts(spark, sf_dir):
    e = _items(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("ordinal"), (F.col("l_linenumber") * 0.5 + (F.col("l_suppkey") % 3) * 0.25).alias("y"), (F.col("l_partkey") % 4 == 0).cast("int").alias("indent"), (F.col("l_linenumber") % 2 == 0).alias("paragraph_start"), F.when(F.col("l_linenumber") % 3 == 0, "layout").alias("paragraph_source"))
    return N.paragraph_starts(e, ["l_orderkey"]).select("l_orderkey", F.col("ordinal").alias("l_linenumber"), "starts")


@query(f"""WITH {LI}, e AS (SELECT l_orderkey AS doc_id, l_linenumber AS entry_ordinal, CAST(l_partkey % 3 AS VARCHAR) AS value, CASE l_suppkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'ambiguous' ELSE 'probable' END AS status FROM li),
g AS (SELECT l_orderkey AS doc_id, l_linenumber AS entry_ordinal, CAST(l_partkey % 3 AS VARCHAR) AS value, CASE l_suppkey % 2 WHEN 0 THEN 'verified' ELSE 'probable' END AS status FROM li)
SELECT g.doc_id, count(*) FILTER (e.status = 'verified') AS num, count(*) AS den, count(*) FILTER (e.status = 'ambiguous') AS silent FROM g JOIN e USING (doc_id, entry_ordinal, value) WHERE g.status = 'verified' GROUP BY 1""")
def association_score(spark, sf_dir):
    li = _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("entry_ordinal"), (F.col("l_partkey") % 3).cast("string").alias("value"), "l_suppkey")
    k = F.col("l_suppkey")
    want = li.withColumn("status", F.when(k % 3 == 0, "verified").when(k % 3 == 1, "ambiguous").otherwise("probable"))
    got = li.withColumn("status", F.when(k % 2 == 0, "verified").otherwise("probable"))
    return M.association_score(want, got)


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN count(*) ELSE 0 END AS den, CASE WHEN lang = 'fr' THEN count(*) FILTER (m = 'unmatched') ELSE 0 END AS num FROM (SELECT source || '/' || lang AS doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'unmatched' ELSE 'exact' END AS m FROM documents ) GROUP BY doc_id, lang""")
def substitution_rejection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("doc_id"), "lang", F.when(F.col("doc_id") % 2 == 0, "unmatched").otherwise("exact").alias("alignment_method"))
    return M.substitution_rejection(d, F.col("lang") == "fr")


@query("""SELECT o_orderkey, '#doc=' || o_custkey || '&line=' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS VARCHAR) ELSE (o_orderkey % 50) || '-' || (o_orderkey % 50 + o_orderkey % 3) END AS link, CAST(o_custkey AS VARCHAR) AS doc, CAST(o_orderkey % 50 AS INTEGER) AS first FROM orders""")
def deep_links(spark, sf_dir):
    k = F.col("o_orderkey")
    link = T.deep_link(F.col("o_custkey"), k % 50 + k % 3, k % 50)
    return table(spark, sf_dir, "orders").select("o_orderkey", link.alias("link"), T.parse_deep_link(link).alias("p")).select("o_orderkey", "link", "p.doc", "p.first")


@query("""SELECT p_partkey, '’' || right(CAST(p_partkey + 7000000 AS VARCHAR), 3) || ' patent' AS short, CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') END AS file FROM part""")
def names_and_files(spark, sf_dir):
    k = F.col("p_partkey")
    shown = F.concat(F.lit("US "), F.format_number(k + 7000000, 0), F.lit(" B2"))
    return table(spark, sf_dir, "part").select("p_partkey", T.short_name(shown).alias("short"), T.safe_name(F.when(k % 4 == 0, F.lit(" / ")).otherwise(F.col("p_name")), F.lit("none")).alias("file"))


@query("""WITH t AS (SELECT doc_id, text AS b, CASE doc_id % 3 WHEN 0 THEN left(text, greatest(length(text) - 2, 0)) WHEN 1 THEN left(text, length(text) // 2) ELSE text || ' one two three four five six seven eight nine ten eleven twelve thirteen' END AS a FROM documents),
w AS (SELECT doc_id, length(b) AS c, length(a) AS d, len(list_filter(regexp_split_to_array(trim(b), '\\s+'), lambda x: x <> '')) AS n, len(list_filter(regexp_split_to_array(trim(a), '\\s+'), lambda x: x <> '')) AS m FROM t)
SELECT doc_id, abs(m - n) <= greatest(2, floor(n * 8 / 100)) AND abs(d - c) <= greatest(12, floor(c * 10 / 100)) AS ok FROM w""")
def conservative_edits(spark, sf_dir):
    b, n = F.col("text"), F.length("text")
    i = F.col("doc_id") % 3
    a = F.when(i == 0, F.left("text", F.greatest(n - 2, F.lit(0)))).when(i == 1, F.left("text", F.floor(n / 2).cast("int"))).otherwise(F.concat(b, F.lit(" one two three four five six seven eight nine ten eleven twelve thirteen")))
    return table(spark, sf_dir, "documents").select("doc_id", T.conservative_edit(b, a).alias("ok"))


@query("""SELECT page_id, coalesce(url LIKE 'https://%' AND regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1) IN ('example.com', 'site1.example'), false) AS allowed FROM pages""")
def url_allow_list(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.allowed_url(F.col("url"), ["example.com", "site1.example"]).alias("allowed"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'x' ELSE 'y' END AS kind FROM events GROUP BY user_id""")
def evidence_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "purchase"), "x").otherwise("y").alias("kind"))


@query("""WITH a AS (SELECT n_regionkey AS k, n_nationkey AS id, 'old' AS v FROM nation), b AS (SELECT r_regionkey AS k, r_regionkey AS id, 'new' AS v FROM region WHERE r_regionkey < 3) SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.id = a.id)""")
def replace_by_key(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("id"), F.lit("old").alias("v"))
    b = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("id"), F.lit("new").alias("v"))
    return L.first_wins_union([a, b], ["k", "id"])


@query("""WITH RECURSIVE m(a, e, b) AS (VALUES ('queued', 'claim', 'running'), ('running', 'expire', 'queued'), ('queued', 'cancel', 'cancelled'), ('running', 'cancel', 'cancelling'), ('cancelling', 'stopped', 'cancelled'), ('running', 'succeed', 'succeeded'), ('running', 'fail', 'failed'), ('failed', 'retry', 'queued'), ('cancelled', 'retry', 'queued')),
e AS (SELECT event_id % 500 AS job_id, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id) AS k, ['claim', 'expire', 'cancel', 'stopped', 'succeed', 'fail', 'retry'][1 + CAST(event_id // 500 * 3 % 7 AS INTEGER)] AS event FROM events),
f AS (SELECT job_id, 0 AS k, 'queued' AS state FROM (SELECT DISTINCT job_id FROM e) UNION ALL SELECT e.job_id, e.k, coalesce(m.b, f.state) FROM f JOIN e ON e.job_id = f.job_id AND e.k = f.k + 1 LEFT JOIN m ON m.a = f.state AND m.e = e.event)
SELECT job_id, arg_max(state, k) AS state FROM f GROUP BY job_id""")
def job_states(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("claim", "expire", "cancel", "stopped", "succeed", "fail", "retry")])
    i = F.col("event_id")
    some = table(spark, sf_dir, "events").select((i % 500).alias("job_id"), i.alias("seq"), F.get(kinds, (F.floor(i / 500) * 3 % 7).cast("int")).alias("event"))
    return J.final_states(some)


@query("""WITH p AS (SELECT page_id, unnest([{'l': 'Inventor', 'v': 'Ann'}, {'l': 'Inventor', 'v': 'Bob'}, {'l': 'Inventor', 'v': 'Ann'}, {'l': 'Filing date', 'v': CAST(page_id AS VARCHAR)}]) AS x FROM pages)
SELECT page_id, 'Inventor=Ann; Bob|Filing date=' || page_id AS front FROM pages""")
def front_matter(spark, sf_dir):
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), b.alias("value"))
    pairs = F.array(pair("Inventor", F.lit("Ann")), pair("Inventor", F.lit(" Bob ")), pair("Inventor", F.lit("Ann")), pair("Filing date", F.col("page_id").cast("string")), pair(" ", F.lit("x")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(H.front_matter(pairs), lambda p: F.concat_ws("=", p["label"], p["value"])), "|").alias("front"))


@query()
def stroke_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct((i / 1000.0).alias("x"), (x.cast("double") / 100).alias("y"))).alias("p"))
    return e.select("vec_id", F.size(V.thinned(F.col("p"))).alias("n"))


@query()
def figure_inference(spark, sf_dir):
    """Sheets and labels made of line items: the order is the document, the line number the sheet."""
    li = _items(spark, sf_dir)
    doc, page = F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_index")
    sheets = li.select(doc, page)
    seen = li.where("l_suppkey % 3 <> 0").select(doc, page, F.col("l_linenumber").cast("string").alias("figure_id"), (F.col("l_quantity") / 50).alias("score"), F.lit("spec_exact").alias("method"))
    expected = li.select(doc, F.col("l_linenumber").cast("string").alias("figure_id"))
    return FG.with_inferred(seen, sheets, expected)


@query()
def figure_sequence(spark, sf_dir):
    li = _items(spark, sf_dir)
    f = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_index"), (F.col("l_partkey") % 9 + 1).cast("string").alias("figure_id"), (F.col("l_quantity") / 50).alias("score"))
    return C.sequenced_figures(f)


@query()
def page_routing(spark, sf_dir):
    w = _words(spark, sf_dir)
    native = w.where("doc_id % 2 = 0")
    pages, _ = A.routed_pages(w.select("doc_id", "page_index").distinct(), native, w.where("doc_id % 3 = 0"))
    return pages


@query()
def callout_choice(spark, sf_dir):
    li = _items(spark, sf_dir)
    x, y = F.col("l_quantity") / 60, F.col("l_discount") * 8
    c = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.format_string("callout_%04d", "l_linenumber").alias("callout_id"), F.translate((F.col("l_partkey") % 40 + 100).cast("string"), "10", "IO").alias("value"), G.box(x, y, x + 0.04, y + 0.02).alias("box"), (F.col("l_suppkey") % 100).cast("double").alias("confidence"))
    ev = li.where("l_linenumber < 3").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40 + 100).cast("string").alias("value")).distinct().withColumn("support", F.lit(1.0))
    return C.chosen(c, ev).select("doc_id", "callout_id", "value", "score", "method")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'point' WHEN 2 THEN 'area' WHEN 3 THEN 'points' ELSE 'opacity' END AS problem FROM events""")
def annotation_check(spark, sf_dir):
    i = F.col("event_id")
    x = F.format_string("%.2f", (i % 90) / 100.0)
    kind = F.when(i % 5 < 2, "note").when(i % 5 == 2, "highlight").when(i % 5 == 3, "drawing").otherwise("bookmark")
    g = (
        F.when(i % 5 == 0, F.concat(F.lit('{"x":'), x, F.lit(',"y":0.5}'))).when(i % 5 == 1, F.lit('{"x":true,"y":0.5}')).when(i % 5 == 2, F.concat(F.lit('{"x0":0.95,"y0":0.1,"y1":0.2,"x1":'), x, F.lit("}")))
        .when(i % 5 == 3, F.lit('{"points":[[0.1,0.2]]}')).otherwise(F.lit('{"x":0.1,"y":0.5,"opacity":7}'))
    )
    return table(spark, sf_dir, "events").select("event_id", R.annotation_problem(kind, g).alias("problem"))


@query("""WITH h AS (SELECT flag AS k, level, count(*) AS n FROM (SELECT l_returnflag AS flag, CAST(l_quantity * (1 + l_linenumber % 2 * 3) AS INTEGER) AS level FROM lineitem) GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER c AS w0, sum(n * level) OVER c AS s0, sum(n) OVER (PARTITION BY k) AS wt, sum(n * level) OVER (PARTITION BY k) AS st FROM h WINDOW c AS (PARTITION BY k ORDER BY level ROWS UNBOUNDED PRECEDING)),
v AS (SELECT k, level, CAST(w0 AS DOUBLE) * CAST(wt - w0 AS DOUBLE) * power(CAST(s0 AS DOUBLE) / w0 - CAST(st - s0 AS DOUBLE) / (wt - w0), 2) AS v FROM w WHERE w0 > 0 AND wt > w0)
SELECT k, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, level) AS r FROM v) WHERE r = 1""")
def otsu_threshold(spark, sf_dir):
    level = (F.col("l_quantity") * (1 + F.col("l_linenumber") % 2 * 3)).cast("int")
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), level.alias("level")).agg(F.count("*").alias("n"))
    return R.otsu(h, ["k"])


@query("""WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_index, CAST(l_partkey AS VARCHAR) AS figure_id FROM lineitem WHERE l_quantity > 25), o AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_index, CAST(l_suppkey AS VARCHAR) AS figure_id FROM lineitem)
SELECT *, 'native_text' AS method FROM n UNION ALL SELECT *, 'ocr' FROM o ANTI JOIN n USING (doc_id, page_index)""")
def drawing_completion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"), "l_partkey", "l_suppkey", "l_quantity")
    native = li.where("l_quantity > 25").select("doc_id", "page_index", F.col("l_partkey").cast("string").alias("figure_id"), F.lit("x").alias("method"))
    return R.completed_drawings(native, li.select("doc_id", "page_index", F.col("l_suppkey").cast("string").alias("figure_id"), F.lit("ocr").alias("method")))


@query("""WITH d AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'US' || (1000000 + p_partkey) || 'B2' ELSE p_name END AS c, p_partkey FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'US ' || format('{:,}', 1000000 + p_partkey) || ' B2' ELSE c END AS display FROM d""")
def display_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    c = F.when(k % 3 == 0, F.concat(F.lit("US"), k + 1000000, F.lit("B2"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", R.display_number(c).alias("display"))


@query()
def column_split(spark, sf_dir):
    return R.column_boundary(_words(spark, sf_dir))
