"""Small operators of every day on the provided tables: parsing, geometry, lookups, selections, records; each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import align as A
from tessera.operators import artifacts as R
from tessera.operators import callouts as C
from tessera.operators import library as L
from tessera.operators import mentions as M
from tessera.operators import navigation as N
from tessera.operators import records
from tessera.operators import selection as S
from tessera.operators import view as V
from tessera.plans.documents import LI, _items
from tessera.sources import files
from tessera.sources import html as H
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH t AS (SELECT p_partkey, translate(CAST(p_partkey % 97 AS VARCHAR), '015', 'OIS') || CASE WHEN p_partkey % 3 = 0 THEN '.' ELSE '' END AS token FROM part), d AS (SELECT *, translate(rtrim(token, '.'), 'OolIiSsBZGg', '00111558266') AS n FROM t)
SELECT p_partkey, token, CASE WHEN CAST(n AS INTEGER) % 5 = 0 AND CAST(n AS INTEGER) BETWEEN 5 AND 70 THEN CAST(n AS INTEGER) END AS printed FROM d""")
def digit_repair(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate((k % 97).cast("string"), "015", "OIS"), F.when(k % 3 == 0, ".").otherwise("")).alias("token"))
    return p.select("p_partkey", "token", T.gutter_value(F.col("token")).alias("printed"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS INTEGER) END AS number, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 + p_partkey % 26 WHEN 2 THEN 2 END AS suffix FROM part""")
def figure_order(spark, sf_dir):
    k = F.col("p_partkey")
    one = F.when(k % 4 == 0, F.col("p_size").cast("string")).when(k % 4 == 1, F.concat("p_size", F.chr(97 + k % 26))).when(k % 4 == 2, F.concat("p_size", F.lit("B"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.figure_key(one).alias("f")).select("p_partkey", "f.number", F.col("f.suffix").cast("long").alias("suffix"))


@query("""SELECT p_brand AS doc_id, CAST(p_size AS VARCHAR) || 'A' AS figure_id FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_brand, CAST(p_size % 7 AS VARCHAR) || 'A' FROM part WHERE p_partkey % 2 = 1""")
def figure_union(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    a = p.where(k % 2 == 0).select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("Fig. "), "p_size", F.lit(" a")).alias("figure_id"))
    b = p.where(k % 2 == 1).select(F.col("p_brand").alias("doc_id"), F.concat(F.col("p_size") % 7, F.lit("A")).alias("figure_id"))
    return S.figure_ids([a, b])


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS bold, p_partkey % 3 = 0 AS sheet, p_size + 1880 BETWEEN 1900 AND 2099 AS year FROM part""")
def name_tests(spark, sf_dir):
    k = F.col("p_partkey")
    font = F.when(k % 4 == 0, " ").when(k % 4 == 1, "Times-BOLD").when(k % 4 == 2, "HelveticaBlack").otherwise("Times-Roman")
    head = F.when(k % 3 == 0, F.concat(F.lit("x Sheet "), k + 1, F.lit(" of 99"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_bold_font(font).alias("bold"), T.is_sheet_header(head).alias("sheet"), T.is_year((F.col("p_size") + 1880).cast("string")).alias("year"))


@query("""SELECT doc_id, nullif(left(trim(text), 300), '') AS cleaned, CASE WHEN doc_id % 2 = 0 THEN 'a b ' || doc_id ELSE CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) BETWEEN 1 AND 120 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END END AS name FROM documents""")
def clean_names(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  a \t b\n"), F.col("doc_id"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_string(F.concat(F.lit("\x00"), "text"), 300).alias("cleaned"), records.workspace_name(name).alias("name"))


@query(f"""WITH {LI} SELECT l_orderkey, l_linenumber FROM li WHERE l_linenumber = 3 AND CAST(l_quantity AS INTEGER) = 14 ORDER BY l_orderkey LIMIT 1""")
def find_entry(spark, sf_dir):
    e = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("column"), F.col("l_quantity").cast("int").alias("line"), F.col("l_orderkey").alias("ordinal"))
    return N.find_ref(e, " 3 : 14 ").select("l_orderkey", "l_linenumber")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'What is' WHEN turn % 5 = 4 THEN 'claimed is:' WHEN turn % 7 = 6 THEN ' Claims 1' ELSE text END AS text FROM conversations WHERE text IS NOT NULL), n AS (SELECT *, trim(text) || ' ' || coalesce(trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '') AS pair FROM t)
SELECT conv_id, min(turn) AS claims_start FROM n WHERE regexp_matches(trim(text), '(?i)^(claims?|what is claimed|i claim|we claim)\\b') OR regexp_matches(pair, '(?i)^(claims?|what is claimed|i claim|we claim)\\b') GROUP BY conv_id""")
def claims_begin(spark, sf_dir):
    k = F.col("turn")
    text = F.when(k % 5 == 3, "What is").when(k % 5 == 4, "claimed is:").when(k % 7 == 6, " Claims 1").otherwise(F.col("text"))
    return N.claims_start(table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.alias("text")), ["conv_id"], "turn")


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '1,2,3' ELSE '1,2' END AS numbers FROM benchmark""")
def claim_list(spark, sf_dir):
    t = F.concat(F.lit("1. A device\n"), F.regexp_replace("text", r"[0-9\n]", " "), F.lit("\n2.A part\n1.5 mm\n"), F.when(F.col("item_id") % 2 == 0, "  3. Last\n7. none").otherwise("5. none"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(N.claim_numbers(t), lambda x: x.cast("string")), ",").alias("numbers"))


@query(f"""WITH {LI}, b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS q, l_quantity / 100 AS x0, l_discount AS y0, l_quantity / 100 + 0.25 AS x1, l_discount + 0.5 AS y1 FROM li)
SELECT l_orderkey, l_linenumber, round(CASE q WHEN 1 THEN 1 - y1 WHEN 2 THEN 1 - x1 WHEN 3 THEN y0 ELSE x0 END, 9) AS seen, round(x0, 9) AS back FROM b""")
def view_rotation(spark, sf_dir):
    q, d, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    e = _items(spark, sf_dir).withColumn("b", G.box(q / 100, d, q / 100 + 0.25, d + 0.5)).withColumn("r", V.rotated(F.col("b"), n)).withColumn("u", G.unrotated(F.col("r"), n))
    return e.select("l_orderkey", "l_linenumber", F.round("r.x0", 9).alias("seen"), F.round("u.x0", 9).alias("back"))


@query(f"""WITH {LI} SELECT l_orderkey, l_linenumber, round(0.1 + 0.8 * least(l_linenumber, 7.0) / 7, 9) AS x0, round(0.2 + least(0.1 * l_quantity / 100, 0.003), 9) AS y0, round(0.1 + 0.5 * l_discount, 9) AS cx, round(0.2 + 0.4 * l_quantity / 100, 9) AS cy FROM li""")
def span_and_crop(spark, sf_dir):
    q, d, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    line, crop = G.box(F.lit(0.1), F.lit(0.2), F.lit(0.9), 0.2 + q / 100), G.box(F.lit(0.1), F.lit(0.2), F.lit(0.6), F.lit(0.6))
    e = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", V.span_box(line, n, n + 1, F.lit(7)).alias("s"), G.from_crop(G.box(d, q / 100, d + 0.1, q / 100 + 0.1), crop).alias("c"))
    return e.select("l_orderkey", "l_linenumber", F.round("s.x0", 9).alias("x0"), F.round("s.y0", 9).alias("y0"), F.round("c.x0", 9).alias("cx"), F.round("c.y0", 9).alias("cy"))


@query(f"""WITH {LI}, b AS (SELECT l_orderkey, l_linenumber, l_quantity * 30 AS x0, l_quantity * 30 + (l_linenumber - 3) * 100 AS x1 FROM li)
SELECT l_orderkey, l_linenumber, CASE WHEN least(x1 / 1000, 1) > least(x0 / 1000, 1) THEN round(least(x1 / 1000, 1), 9) END AS safe_x1, x0 / 2000 < x1 / 2000 AND x1 / 2000 <= 1 AS valid, round(CASE WHEN greatest(least(x1 / 2000, 1), 0) <= least(x0 / 2000, 1) THEN least(1, least(x0 / 2000, 1) + 1e-4) ELSE least(x1 / 2000, 1) END, 9) AS clamped_x1 FROM b""")
def box_repair(spark, sf_dir):
    q, n = F.col("l_quantity") * 30, (F.col("l_linenumber") - 3) * 100
    half = G.box(q / 2000, F.lit(0.1), (q + n) / 2000, F.lit(0.2))
    e = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", G.safe(G.box(q, F.lit(100.0), q + n, F.lit(200.0))).alias("s"), G.is_valid(half).alias("valid"), G.clamped(half).alias("c"))
    return e.select("l_orderkey", "l_linenumber", F.round("s.x1", 9).alias("safe_x1"), "valid", F.round("c.x1", 9).alias("clamped_x1"))


@query(f"""WITH {LI} SELECT l_orderkey, l_linenumber, round(l_quantity + 4 * ln(1 + l_partkey % 100) - 25 * l_discount, 9) AS score, CAST(CASE WHEN l_discount < 0.013 * 0.55 THEN 0 ELSE greatest(1, least(6, round_even(l_discount / 0.013, 0))) END AS INTEGER) AS indent FROM li""")
def layout_scores(spark, sf_dir):
    e = _items(spark, sf_dir)
    return e.select("l_orderkey", "l_linenumber", F.round(G.candidate_score(F.col("l_quantity"), F.col("l_partkey") % 100, F.col("l_discount")), 9).alias("score"), G.indent_level(F.col("l_discount"), F.lit(0.02)).alias("indent"))


@query(f"""WITH {LI}, p AS (SELECT l_orderkey, l_linenumber AS point_id, l_quantity / 50 AS x, l_discount * 8 AS y FROM li), l AS (SELECT l_orderkey, l_linenumber AS ordinal, 0.1 AS x0, l_linenumber * 0.1 AS y0, 0.9 AS x1, l_linenumber * 0.1 + 0.05 AS y1 FROM li),
d AS (SELECT p.l_orderkey, point_id, ordinal, sqrt(greatest(x0 - x, x - x1, 0) ** 2 + greatest(y0 - y, y - y1, 0) ** 2) AS d FROM p JOIN l USING (l_orderkey)), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, point_id ORDER BY round(d, 12), ordinal) AS k FROM d WHERE d <= 0.045)
SELECT p.l_orderkey, p.point_id, CAST(r.ordinal AS VARCHAR) AS entry_id FROM p LEFT JOIN r ON r.l_orderkey = p.l_orderkey AND r.point_id = p.point_id AND k = 1""")
def line_at_point(spark, sf_dir):
    e, n = _items(spark, sf_dir), F.col("l_linenumber")
    points = e.select("l_orderkey", n.alias("point_id"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 8).alias("y"))
    lines = e.select("l_orderkey", n.cast("string").alias("entry_id"), n.alias("ordinal"), G.box(F.lit(0.1), n * 0.1, F.lit(0.9), n * 0.1 + 0.05).alias("box"))
    return V.line_at(points, lines, ["l_orderkey"], 0.045).select("l_orderkey", "point_id", "entry_id")


@query(f"""WITH {LI}, o AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 4 + 1 AS VARCHAR) AS f, min(l_linenumber) AS p FROM li WHERE l_partkey % 4 > 0 GROUP BY 1, 2), w AS (SELECT DISTINCT l_orderkey AS doc_id, unnest(['1', '2', '4']) AS f FROM li)
SELECT w.doc_id, 'FIG. ' || w.f AS figure_id, coalesce(o.p, CASE WHEN w.f = '1' AND s.p >= 1 THEN s.p - 1 END) AS page_index FROM w LEFT JOIN o ON o.doc_id = w.doc_id AND o.f = w.f LEFT JOIN o s ON s.doc_id = w.doc_id AND s.f = '2'""")
def figure_page(spark, sf_dir):
    e = _items(spark, sf_dir)
    o = e.where("l_partkey % 4 > 0").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("fig "), F.col("l_partkey") % 4 + 1).alias("figure_id"), F.col("l_linenumber").alias("page_index"))
    wanted = e.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*[F.lit(f"FIG. {i}") for i in (1, 2, 4)])).alias("figure_id"))
    return M.figure_pages(wanted, o).select("doc_id", "figure_id", "page_index")


@query(f"""WITH {LI}, m AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, (l_partkey % 3) || 'a' AS v FROM li), c AS (SELECT l_orderkey AS doc_id, (l_suppkey % 3) || 'A' AS v, 'c' || l_linenumber AS cid FROM li)
SELECT m.doc_id, m.ordinal, m.v AS value, CASE count(cid) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'probable' ELSE 'ambiguous' END AS status FROM m LEFT JOIN c ON c.doc_id = m.doc_id AND c.v = upper(m.v) GROUP BY 1, 2, 3""")
def folded_links(spark, sf_dir):
    e = _items(spark, sf_dir)
    doc, n = F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber")
    m = e.select(doc, n.alias("ordinal"), F.lit(0).alias("start"), F.concat(F.col("l_partkey") % 3, F.lit("a")).alias("value"))
    none = m.limit(0).select("doc_id", "ordinal", "start", F.array(F.lit("1")).alias("figure_ids"))
    c = e.select(doc, F.concat(F.col("l_suppkey") % 3, F.lit("A")).alias("value"), F.lit("1").alias("figure_id"), F.concat(F.lit("c"), n).alias("callout_id"))
    return M.associations(M.figure_context(m, none), c, fold_case=True).select("doc_id", "ordinal", "value", "status")


@query("""WITH a AS (SELECT o_orderkey AS artifact_id, o_custkey % 500 AS source_id, o_orderpriority AS config_hash, o_orderdate AS ready_at FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 > 0), s AS (SELECT c_custkey AS source_id, CAST(c_custkey % 40 AS VARCHAR) AS sha256 FROM customer WHERE c_nationkey = 3)
SELECT artifact_id, sha256, config_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256, config_hash ORDER BY ready_at DESC, artifact_id DESC) AS k FROM a JOIN s USING (source_id)) WHERE k = 1""")
def reusable_artifacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "complete_with_warnings").otherwise("partial")
    a = o.select(F.col("o_orderkey").alias("artifact_id"), (F.col("o_custkey") % 500).alias("source_id"), F.col("o_orderpriority").alias("config_hash"), F.col("o_orderdate").alias("ready_at"), F.when(F.col("o_orderkey") % 5 > 0, "key").alias("object_key"), kind.alias("disposition"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 40).cast("string").alias("sha256"), F.col("c_nationkey").alias("owner_id"))
    return L.reusable(a, s, 3).select("artifact_id", "sha256", "config_hash")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer""")
def upserted_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return files.upserted(c, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name")), ["c_custkey"])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'complete_with_warnings' ELSE 'complete_with_warnings' END AS disposition FROM orders""")
def published_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "odd").alias("disposition"))
    return records.published(o)


@query("""SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5 AND c_custkey % 2 = 0""")
def fetch_jobs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_nationkey") == 5, "fetch").otherwise("upload").alias("source_type"), F.when(F.col("c_custkey") % 2 == 1, "k").alias("pdf_object_key"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"))
    return records.needs_fetch(jobs, c.select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("source_id")), s).select("o_orderkey")


@query("""SELECT p_partkey, array_to_string(list_filter([CAST(p_size AS INTEGER), CAST(p_partkey AS INTEGER), 0, 999, 1000], lambda x: x BETWEEN 1 AND 999), ',') AS numbers, CASE WHEN p_size > 30 THEN (p_size - 3 + 2) % p_size ELSE 0 END AS at FROM part""")
def valid_numbers(spark, sf_dir):
    n = F.array(F.col("p_size").cast("int"), F.col("p_partkey").cast("int"), F.lit(0), F.lit(999), F.lit(1000))
    at = F.when(F.col("p_size") > 30, N.next_match(F.lit(2), F.lit(-3), F.col("p_size"))).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(records.claim_numbers_valid(n), lambda x: x.cast("string")), ",").alias("numbers"), at.alias("at"))


@query("""SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1""")
def last_of_key(spark, sf_dir):
    return records.last_labels(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


@query("""WITH a AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'verified' ELSE 'mismatch' END AS s, doc_id % 4 AS n, doc_id % 2 AS e FROM documents WHERE doc_id % 5 < 4), b AS (SELECT doc_id, 'b' || doc_id AS u FROM documents WHERE doc_id % 7 < 5)
SELECT doc_id, CASE WHEN good THEN text ELSE u END AS clean_text, CASE WHEN good THEN 'first' WHEN u IS NOT NULL THEN 'second' END AS provider FROM (SELECT *, coalesce(text <> '' AND s = 'verified' AND (e = 0 OR n > 0), false) AS good FROM a FULL JOIN b USING (doc_id))""")
def provider_choice(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    a = d.where(k % 5 < 4).select("doc_id", F.col("text").alias("clean_text"), F.when(k % 3 == 0, "verified").otherwise("mismatch").alias("status"), (k % 4).alias("n_aligned"), (k % 2).alias("n_entries"))
    return A.preferred_provider(a, d.where(k % 7 < 5).select("doc_id", F.concat(F.lit("b"), k).alias("clean_text")), ["doc_id"])


@query("""SELECT page_id, nullif(regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bname\\s*=\\s*["'']description["'']'))[1], '(?i)\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS description FROM pages""")
def page_meta(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.meta(F.col("html"), "description").alias("description"))


@query(f"""WITH {LI} SELECT l_orderkey AS doc_id, k - 1 AS word_ix, 'w' || l_partkey AS text, round(l_quantity / 100, 9) AS x0, round((l_quantity + 5) / 100, 9) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM li) WHERE l_linenumber % 4 > 0 AND l_suppkey % 100 >= 40""")
def recognised_words(spark, sf_dir):
    one = F.struct("l_linenumber", F.when(F.col("l_linenumber") % 4 > 0, 5).otherwise(4).alias("level"), F.concat(F.lit(" w"), "l_partkey").alias("text"), (F.col("l_suppkey") % 100).cast("double").alias("conf"), F.col("l_quantity").cast("double").alias("left"))
    w = F.col("w")
    per = _items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("w"), F.lit(100.0).alias("page_width"), F.lit(100.0).alias("page_height"))
    same = lambda v: F.transform(w, lambda x: F.lit(v))
    tsv = per.select("doc_id", F.lit(0).alias("page_index"), "page_width", "page_height", w["level"].alias("level"), w["text"].alias("text"), w["conf"].alias("conf"), w["left"].alias("left"), same(10.0).alias("top"), same(5.0).alias("width"), same(2.0).alias("height"), same(1).alias("block_num"), same(1).alias("par_num"), same(1).alias("line_num"))
    got = files.words_from_tsv(tsv, 40)
    return got.select("doc_id", F.col("word_ix").cast("long").alias("word_ix"), "text", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"), "confidence")


@query("""SELECT page_id AS page_index, 'a' || page_id AS text, CASE WHEN page_id % 2 = 0 THEN 0.25 END AS x0 FROM pages WHERE page_id % 3 = 0""")
def stored_words(spark, sf_dir):
    k = F.col("page_id")
    payload = F.concat(F.lit('[["a'), k, F.when(k % 2 == 0, '","0.25","0.5"]]').otherwise('"]]'))
    c = table(spark, sf_dir, "pages").select(F.lit("s").alias("source_id"), F.lit("words").alias("kind"), F.when(k % 3 == 0, "k1").otherwise("k2").alias("cache_key"), k.alias("page_index"), payload.alias("payload"))
    return files.checkpointed_words(c, "s", "words", "k1").select("page_index", "text", "x0")


@query("""SELECT conv_id, turn, turn % 4 = 2 OR CAST(turn // 3 AS VARCHAR) IS DISTINCT FROM lag(CAST(turn // 3 AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn, role) AS starts FROM conversations""")
def application_starts(spark, sf_dir):
    t = F.col("turn")
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(t / 3).cast("string").alias("paragraph"), F.when(t % 4 == 2, True).alias("paragraph_start"))
    return N.application_starts(e, ["conv_id"], "turn").select("conv_id", "turn", "starts")


@query("""WITH p AS (SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 4, '0') AS a, lpad(CAST(p_size + p_partkey % 2 AS VARCHAR), 4, '0') AS b FROM part), r AS (SELECT *, CASE WHEN a = b THEN '¶ [' || a || ']' ELSE '¶¶ [' || a || ']–[' || b || ']' END AS ref FROM p)
SELECT p_partkey, ref, '’' || right(CAST(p_partkey + 7000000 AS VARCHAR), 3) || ' patent ' || ref AS cited FROM r""")
def paragraph_citations(spark, sf_dir):
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    ref = T.paragraph_citation(pad(F.col("p_size")), pad(F.col("p_size") + F.col("p_partkey") % 2))
    return table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"), T.full_citation(ref, (F.col("p_partkey") + 7000000).cast("string")).alias("cited"))


@query("""SELECT page_id, 'first|second ' || page_id || '|third' AS paragraphs FROM pages""")
def numbered_paragraphs(spark, sf_dir):
    t = F.concat(F.lit("(1) first\n[2] second<br/>"), F.col("page_id"), F.lit("\n\n (3)third"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(H.numbered_paragraphs(t), "|").alias("paragraphs"))


@query("""SELECT source AS doc_id, doc_id AS page_index, n_chars % 5 = 0 OR n_chars % 3 = 0 AS is_drawing FROM documents""")
def drawing_pages(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    pages = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), "n_chars")
    w = pages.where("n_chars % 5 <> 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("doc_id", "page_index", F.col("i").alias("word_ix"), F.when((n % 3 == 0) & (F.col("i") <= 2), "12A").otherwise("word").alias("text"), (F.col("i") * 0.1).alias("x0"), F.lit(0.5).alias("y0"), (F.col("i") * 0.1 + 0.05).alias("x1"), F.lit(0.52).alias("y1"), F.lit(None).cast("double").alias("confidence"))
    return C.drawing_pages(pages, w)


@query("""WITH s AS (SELECT doc_id, 'Device ' || (100 + doc_id % 50) || ' here' AS t, CAST(100 + doc_id % 50 AS VARCHAR) AS v, doc_id % 10 / 10.0 AS c FROM documents) SELECT doc_id, v AS value, 7 AS "start", 10 AS "end" FROM s WHERE c >= 0.82""")
def suggested_numerals(spark, sf_dir):
    k = F.col("doc_id")
    e = table(spark, sf_dir, "documents").select("doc_id", F.lit("e").alias("entry_id"), F.concat(F.lit("Device "), 100 + k % 50, F.lit(" here")).alias("display_text"))
    s = e.select("doc_id", "entry_id", (100 + k % 50).cast("string").alias("value"), F.lit("device").alias("component_label"), (k % 10 / 10.0).alias("confidence"))
    return R.suggested_numerals(e, s).select("doc_id", "value", "start", "end")


@query("""SELECT doc_id, 5 AS "start", CAST(5 + length('fig. ' || (doc_id % 9 + 1) || ' and 20') AS INTEGER) AS "end", (doc_id % 9 + 1) || ',20' AS ids FROM documents WHERE doc_id % 10 >= 7""")
def suggested_figures(spark, sf_dir):
    k = F.col("doc_id")
    raw = F.concat(F.lit("FIG. "), k % 9 + 1, F.lit(" and 20"))
    e = table(spark, sf_dir, "documents").select("doc_id", F.lit("e").alias("entry_id"), F.concat(F.lit("See, "), F.lower(raw), F.lit(".")).alias("display_text"))
    s = e.select("doc_id", "entry_id", raw.alias("raw_text"), (k % 10 / 10.0).alias("confidence"))
    return R.suggested_figures(e, s).select("doc_id", "start", "end", F.array_join("figure_ids", ",").alias("ids"))


@query(f"""WITH {LI} SELECT l_orderkey, array_to_string(list(DISTINCT CAST(l_suppkey % 4 AS INTEGER) ORDER BY CAST(l_suppkey % 4 AS INTEGER)), ',') AS pages, count(*) FILTER (l_partkey % 2 = 0) AS corrected, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber) AS parts FROM li GROUP BY 1""")
def page_sets(spark, sf_dir):
    e = _items(spark, sf_dir).withColumns({"page_index": (F.col("l_suppkey") % 4).cast("int"), "display_text": F.lit("a"), "source_text": F.when(F.col("l_partkey") % 2 == 0, "b").otherwise("a"), "part": F.col("l_partkey").cast("string")})
    pages, corrected, parts = S.page_set(e, ["l_orderkey"]), S.corrected_count(e, ["l_orderkey"]), S.by_key(e, ["l_orderkey"], "l_linenumber", "part")
    both = pages.join(corrected, "l_orderkey").join(parts, "l_orderkey")
    return both.select("l_orderkey", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "corrected", F.array_join("items", ",").alias("parts"))


@query(f"""WITH {LI}, s AS (SELECT l_orderkey, l_linenumber FROM li WHERE l_linenumber BETWEEN least(2 + l_orderkey % 3, 4) AND greatest(2 + l_orderkey % 3, 4)) SELECT l_orderkey, l_linenumber, n > 2 AS capped FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k FROM s SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)) WHERE k <= 2""")
def selection_capped(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    s = S.members(S.between(_items(spark, sf_dir), 2 + F.col("l_orderkey") % 3, F.lit(4), "l_linenumber"), chosen, ["l_orderkey"])
    return S.capped(s, ["l_orderkey"], [F.desc("l_linenumber")], 2).select("l_orderkey", "l_linenumber", "capped")


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(replace(text, 'a ', 'a ' || chr(10)), '\\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, CASE WHEN t <> '' THEN '“' || t || '” (' || turn || ':1)' END AS quote FROM t""")
def quotes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", S.quoted(F.replace("text", F.lit("a "), F.lit("a \n")), T.grant_ref(F.col("turn"), F.lit(1))).alias("quote"))


@query("""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')) AS INTEGER) AS n FROM documents""")
def text_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.blocks(F.col("text"))).alias("n"))


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'old' || doc_id ELSE lang END AS lang, source FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""")
def carried_fields(spark, sf_dir):
    before = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.when(F.col("q") == 1, F.concat(F.lit("old"), "doc_id")).alias("lang"))
    return S.carried(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), before, ["doc_id"], ["lang"])


@query("""SELECT event_id, 'https://pages.example/US' || event_id || '/en' AS url, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS public FROM events""")
def page_addresses(spark, sf_dir):
    i = F.col("event_id")
    address = F.when(i % 6 == 0, "8.8.4.4").when(i % 6 == 1, "10.1.2.3").when(i % 6 == 2, "172.20.0.1").when(i % 6 == 3, "172.32.0.1").when(i % 6 == 4, "300.1.1.1")
    return table(spark, sf_dir, "events").select("event_id", S.page_url(F.lit("https://pages.example/"), F.concat(F.lit("US"), i)).alias("url"), S.is_public_address(address).alias("public"))


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)""")
def get_or_create(spark, sf_dir):
    o = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return S.inserted(o, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v")), ["k"])


@query("""SELECT event_id FROM events WHERE event_id % 4 > 0 AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-02' AND (event_id % 2 = 0 OR event_id % 3 = 0)""")
def import_commits(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(i % 4 == 0, F.col("ts")).alias("consumed_at"), F.expr("ts + interval 1 hour").alias("expires_at"), F.when(i % 2 == 0, 2).otherwise(1).alias("schema_version"), F.when(i % 3 == 0, True).alias("confirmed"))
    return S.committed_imports(e, F.lit("2024-01-02").cast("timestamp_ntz")).select("event_id")


@query("""SELECT user_id AS actor, event_type AS action, sha256(CAST(event_id AS VARCHAR)) AS target FROM events""")
def audit_log(spark, sf_dir):
    return S.audit_rows(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "ts").select("actor", "action", "target")


@query("""SELECT source AS doc_id, count(*) AS suggested, count(*) FILTER (toxic = 1) AS taken, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 'nothing_taken' END AS warning FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def review_counts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return S.review_summary(d.select(F.col("source").alias("doc_id"), (F.col("toxic") == 1).alias("taken")))


@query("""SELECT s_suppkey AS source_id, coalesce(r, false) AS ready FROM supplier LEFT JOIN (SELECT event_id % 150 AS s_suppkey, arg_max(event_type = 'purchase', event_id) AS r FROM events GROUP BY 1) USING (s_suppkey)""")
def source_ready(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select((F.col("event_id") % 150).alias("source_id"), F.col("event_id").alias("checked_at"), (F.col("event_type") == "purchase").alias("ready"))
    return S.ready_sources(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")), checks)


@query(f"""WITH {LI} SELECT l_orderkey, '{{"l_orderkey":' || l_orderkey || ',"references":[' || string_agg('{{"ordinal":' || l_linenumber || ',"ref":"1:' || l_partkey || '"}}', ',' ORDER BY l_linenumber) || '],"_scaffold":{{"verified":false}}}}' AS json FROM li GROUP BY 1""")
def label_scaffold(spark, sf_dir):
    e = _items(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("ordinal"), T.grant_ref(F.lit(1), F.col("l_partkey")).alias("ref"))
    return S.scaffold(e, ["l_orderkey"])
