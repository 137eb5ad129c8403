"""Text, mention, line and navigation operators on the provided tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.operators import align as A
from tessera.operators import callouts as C
from tessera.operators import lines as W
from tessera.operators import mentions as M
from tessera.operators import metrics
from tessera.operators import navigation as N
from tessera.sources import html as H
from tessera.sources import portable as P
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Line items, one a number of an order.
LI = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount")])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda t: trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))), lambda t: t <> ''), '|') AS tokens FROM documents""")
def normalize_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.normalized_tokens(F.col("text")), "|").alias("tokens"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(replace(text, 'a ', 'a-' || chr(10) || ' '), '(\\p{L})[-‐‑]\\s*\\n\\s*(\\p{L})', '\\1\\2', 'g'), '(\\p{L})[-‐‑]\\s*\\n\\s*(\\p{L})', '\\1\\2', 'g') AS joined FROM documents""")
def dehyphenate(spark, sf_dir):
    t = F.replace("text", F.lit("a "), F.lit("a-\n "))  # whole texts, with breaks wherever a word ends in a
    return table(spark, sf_dir, "documents").select("doc_id", T.dehyphenated(t).alias("joined"))


def _references() -> tuple[str, str]:
    """SQL rows (name, characters) of all named character references, and the names that need no semicolon, longer ones first."""
    rows = ", ".join("('{}', '{}')".format(n, c.replace("'", "''")) for n, c in html5.items())
    return rows, "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))


_NAMED, _SHORT = _references()


@query(f"""WITH ref(name, ch) AS (VALUES {_NAMED}), t AS (SELECT page_id, string_split(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&') AS parts FROM pages),
p AS (SELECT page_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS s FROM t),
n AS (SELECT *, CASE WHEN i > 1 THEN regexp_extract(s, '^[A-Za-z0-9]{{1,31}};') END AS named, CASE WHEN i > 1 THEN regexp_extract(s, '^({_SHORT})') END AS short, CASE WHEN i > 1 THEN regexp_extract(s, '^#([0-9]{{1,6}});?', 1) END AS dec, CASE WHEN i > 1 THEN regexp_extract(s, '^#[xX]([0-9a-fA-F]{{1,5}});?', 1) END AS hex FROM p),
o AS (SELECT page_id, i, CASE WHEN i = 1 THEN s WHEN r.ch IS NOT NULL THEN r.ch || substr(s, length(named) + 1) WHEN dec <> '' THEN chr(CAST(dec AS INTEGER)) || regexp_replace(s, '^#[0-9]+;?', '')
  WHEN hex <> '' THEN chr(CAST('0x' || hex AS INTEGER)) || regexp_replace(s, '^#[xX][0-9a-fA-F]+;?', '') WHEN q.ch IS NOT NULL THEN q.ch || substr(s, length(short) + 1) ELSE '&' || s END AS u
  FROM n LEFT JOIN ref r ON r.name = n.named LEFT JOIN ref q ON q.name = n.short),
w AS (SELECT page_id, trim(regexp_replace(string_agg(u, '' ORDER BY i), '[\\s\\x{{A0}}]+', ' ', 'g')) AS text FROM o GROUP BY page_id)
SELECT page_id, text FROM pages LEFT JOIN w USING (page_id)""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.stripped_html(F.col("html")).alias("text"))


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title, CAST(len(list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda p: p <> '')) AS INTEGER) AS n_paragraphs FROM pages""")
def html_meta(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.title(h).alias("title"), F.size(H.paragraphs(h)).alias("n_paragraphs"))


@query()
def provider_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.provider_page("html").alias("p")).select("page_id", "p.canonical", "p.title", F.length("p.description").alias("n_description"), F.size("p.metadata").alias("n_metadata"))


@query("""SELECT p_partkey, 'FIGS. ' || p_size || '-' || (p_size + 2) || ' and ' || (p_size + 9) || 'a' AS text, array_to_string([CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR), CAST(p_size + 2 AS VARCHAR), (p_size + 9) || 'A'], ',') AS ids FROM part""")
def figure_expand(spark, sf_dir):
    n = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("FIGS. "), n, F.lit("-"), n + 2, F.lit(" and "), n + 9, F.lit("a")).alias("text"))
    return M.figure_mentions(p, ["p_partkey", "text"], "text").select("p_partkey", "text", F.array_join("figure_ids", ",").alias("ids"))


@query("""WITH p AS (SELECT p_partkey, CAST(100 + p_size AS VARCHAR) AS a, CAST(100 + p_size + 1 AS VARCHAR) AS b FROM part)
SELECT p_partkey, 12 AS "start", 15 AS "end", a AS value, 'housing' AS label FROM p UNION ALL SELECT p_partkey, 20, 23, b, 'housing' FROM p UNION ALL SELECT p_partkey, 25, 28, '77B', 'housing' FROM p UNION ALL SELECT p_partkey, 93, 96, '45A', 'shaft' FROM p""")
def numeral_mentions(spark, sf_dir):
    n = F.col("p_size") + 100
    text = F.concat(F.lit("The housing "), n, F.lit(" and "), n + 1, F.lit(", 77B of claim 12, motor 14 mm, rod 25: gear 2015 or 16 and the shaft 45A here"))
    return M.numeral_mentions(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")


@query(f"""WITH {LI}, n AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CAST(l_partkey % 12 + 100 AS VARCHAR) AS value FROM li), f AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CAST(l_suppkey % 4 AS VARCHAR) AS fig FROM li WHERE l_quantity > 25),
c AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 12 + 100 AS VARCHAR) AS value, CAST(l_suppkey % 4 AS VARCHAR) AS fig, 'c' || l_linenumber AS cid FROM li),
x AS (SELECT n.*, (SELECT fig FROM f WHERE f.doc_id = n.doc_id AND f.ordinal <= n.ordinal ORDER BY f.ordinal DESC LIMIT 1) AS ctx FROM n),
j AS (SELECT x.doc_id, x.ordinal, x.value, list_sort(list(cid) FILTER (cid IS NOT NULL)) AS al, list_sort(list(cid) FILTER (cid IS NOT NULL AND fig = ctx)) AS inn FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.value = x.value GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN coalesce(len(inn), 0) > 0 THEN inn ELSE coalesce(al, []) END AS pool FROM j)
SELECT doc_id, ordinal, value, CASE WHEN len(pool) = 0 THEN 'unresolved' WHEN len(pool) > 1 THEN 'ambiguous' WHEN coalesce(len(inn), 0) > 0 THEN 'verified' ELSE 'probable' END AS status, array_to_string(pool, ',') AS candidates FROM p""")
def associate_status(spark, sf_dir):
    li = _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), "l_partkey", "l_suppkey", "l_quantity")
    n = li.select("doc_id", "ordinal", F.lit(0).alias("start"), (F.col("l_partkey") % 12 + 100).cast("string").alias("value"))
    f = li.where("l_quantity > 25").select("doc_id", "ordinal", F.lit(0).alias("start"), F.array((F.col("l_suppkey") % 4).cast("string")).alias("figure_ids"))
    c = li.select("doc_id", (F.col("l_suppkey") % 12 + 100).cast("string").alias("value"), (F.col("l_suppkey") % 4).cast("string").alias("figure_id"), F.concat(F.lit("c"), "ordinal").alias("callout_id"))
    return M.associations(M.figure_context(n, f), c).select("doc_id", "ordinal", "value", "status", F.array_join("candidates", ",").alias("candidates"))


@query("""SELECT user_id, event_id, (SELECT s.event_id FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND (s.ts, s.event_id) <= (e.ts, e.event_id) ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) AS context FROM events e""")
def figure_context_asof(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("context"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 97 / 100.0 AS x, c_custkey % 89 / 100.0 AS y FROM customer), s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 97 / 100.0 AS x, s_suppkey % 83 / 100.0 AS y FROM supplier),
r AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey IS NULL, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2), s_suppkey) AS k FROM c LEFT JOIN s ON s_nationkey = c_nationkey) SELECT c_custkey, CAST(s_suppkey AS VARCHAR) AS figure_id FROM r WHERE k = 1""")
def nearest_figure(spark, sf_dir):
    at = lambda k, b: G.box(F.col(k) % 97 / 100.0, F.col(k) % b / 100.0, F.col(k) % 97 / 100.0, F.col(k) % b / 100.0)
    c = table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), F.col("c_nationkey").alias("page_index"), F.col("c_custkey").alias("callout_id"), F.lit(None).cast("string").alias("figure_id"), at("c_custkey", 89).alias("box"))
    f = table(spark, sf_dir, "supplier").select(F.lit(0).alias("doc_id"), F.col("s_nationkey").alias("page_index"), F.col("s_suppkey").cast("string").alias("figure_id"), F.col("s_suppkey").alias("position"), at("s_suppkey", 83).alias("box"))
    return M.nearest_figure(c, f).select(F.col("callout_id").alias("c_custkey"), "figure_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported_kind' WHEN o_orderkey % 7 = 1 THEN 'invalid_number' END AS reason,
CASE WHEN o_orderkey % 7 < 2 THEN NULL WHEN o_orderkey % 7 = 2 THEN 'US2015' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || 'A1' WHEN o_orderkey % 7 = 3 THEN 'US' || (1000000 + o_orderkey) || 'B2' ELSE 'US' || (1000000 + o_orderkey) END AS canonical FROM orders""")
def parse_identifier(spark, sf_dir):
    k = F.col("o_orderkey")
    n = (k + 1000000).cast("string")
    raw = (
        F.when(k % 7 == 0, F.concat(n, F.lit(" S"))).when(k % 7 == 1, F.lit("us 2015/123 a1")).when(k % 7 == 2, F.concat(F.lit(" US 2015/"), F.lpad(k.cast("string"), 7, "0"))).when(k % 7 == 3, F.concat(F.lit("U.S. Patent No. "), F.format_number(k + 1000000, 0), F.lit(" B2"))).otherwise(n)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_identifier(raw).alias("p")).select("o_orderkey", "p.reason", "p.canonical")


@query()
def identity_verdict(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    i = F.col("item_id")
    status = A.identity(F.when(i % 3 != 0, F.concat(F.lit("US"), i + 100000, F.lit("B2"))), F.when(i % 3 == 1, F.concat(F.lit("US:"), i + 100000)).when(i % 3 == 2, F.concat(F.lit("US:"), i)), F.col("t"), F.when(i % 2 == 0, F.upper("t")).otherwise(F.left("t", F.lit(20))))
    return b.select("item_id", status.alias("status"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents), h AS (SELECT *, ordinal - lag(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS step FROM l WHERE upper(trim(text)) = trim(text) AND length(regexp_replace(trim(text), '[^A-Za-z]', '', 'g')) >= 3 AND regexp_matches(trim(text), '^[A-Z][A-Z0-9 ,.''()\\-/&]{2,80}$')),
i AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS island FROM h), c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY ordinal) - 1) // 3 AS chunk FROM i)
SELECT doc_id, min(ordinal) AS first, string_agg(trim(text), ' ' ORDER BY ordinal) AS title FROM c GROUP BY doc_id, island, chunk""")
def outline_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    heads = lines.where(T.is_heading_part(F.col("text")))
    runs = N.islands(heads, ["doc_id"], ["ordinal"], F.coalesce(F.col("ordinal") != F.lag("ordinal").over(w) + 1, F.lit(True)))
    chunk = F.floor((F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("ordinal")) - 1) / 3)
    part = F.struct("ordinal", F.trim("text").alias("t"))
    return runs.withColumn("chunk", chunk).groupBy("doc_id", "island", "chunk").agg(F.min("ordinal").cast("long").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), " ").alias("title")).drop("island", "chunk")


@query(f"""WITH {LI}, r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CAST(CASE WHEN l_quantity > 40 THEN 1 ELSE l_linenumber END AS INTEGER) AS number FROM li), b AS (SELECT *, CASE WHEN number = lag(number) OVER (PARTITION BY doc_id ORDER BY ordinal) + 1 AND number > 1 THEN 0 ELSE 1 END AS b FROM r),
i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS island FROM b), g AS (SELECT doc_id, island, count(*) AS n, min(number) AS lo, max(ordinal) AS last FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, island FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, last DESC) AS r FROM g WHERE lo = 1 AND n >= 2) WHERE r = 1) SELECT doc_id, ordinal, number FROM i SEMI JOIN k USING (doc_id, island)""")
def claims_backward(spark, sf_dir):
    r = _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_quantity") > 40, 1).otherwise(F.col("l_linenumber")).cast("int").alias("number"))
    return N.backward_claims(r)


@query(f"""WITH RECURSIVE {LI}, r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CAST(CASE WHEN l_quantity > 40 THEN 1 ELSE l_linenumber END AS INTEGER) AS number FROM li),
f AS (SELECT doc_id, min(ordinal) AS ordinal, 1 AS number FROM r WHERE number = 1 GROUP BY doc_id UNION ALL SELECT f.doc_id, (SELECT min(r.ordinal) FROM r WHERE r.doc_id = f.doc_id AND r.ordinal > f.ordinal AND r.number = f.number + 1), f.number + 1 FROM f WHERE f.ordinal IS NOT NULL)
SELECT doc_id, ordinal, number FROM f WHERE ordinal IS NOT NULL""")
def claims_forward(spark, sf_dir):
    r = _items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_quantity") > 40, 1).otherwise(F.col("l_linenumber")).cast("int").alias("number"))
    return N.forward_claims(r)


@query(f"""WITH {LI}, l AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, CAST(l_quantity AS INTEGER) AS b, l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS c, CAST(l_quantity AS INTEGER) + CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 4 END AS d FROM li)
SELECT l_orderkey, l_linenumber, CASE WHEN a = c AND b = d THEN 'column ' || a || ', line ' || b WHEN a = c THEN 'column ' || a || ', lines ' || b || '–' || d ELSE 'column ' || a || ', line ' || b || ' – column ' || c || ', line ' || d END AS long,
CASE WHEN a = c AND b = d THEN a || ':' || b WHEN a = c THEN a || ':' || b || '-' || d ELSE a || ':' || b || '-' || c || ':' || d END AS colon FROM l""")
def citation_format(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    ends = (F.col("l_linenumber"), q, F.col("l_linenumber") + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0), q + F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(4))
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", T.citation(*ends, preset="verbose").alias("long"), T.citation(*ends).alias("colon"))


@query("""SELECT conv_id AS doc_id, string_agg((turn + 1) || ':' || length(text) || chr(9) || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def export_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), T.grant_ref(F.col("turn") + 1, F.length("text")).alias("ref"), F.col("text").alias("display_text"))
    return N.export_text(c)


@query("""WITH k AS (SELECT item_id % 8 AS c, item_id, text FROM benchmark) SELECT item_id, CASE c WHEN 0 THEN 'unsupported_schema' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_locator' WHEN 3 THEN 'invalid_box' WHEN 4 THEN 'empty' END AS reason,
CASE WHEN c = 6 THEN 'application' ELSE 'grant' END AS doc_type, CAST(CASE WHEN c IN (2, 3, 5, 6, 7) THEN 1 ELSE 0 END AS BIGINT) AS n_entries FROM k""")
def import_validate(spark, sf_dir):
    t = F.concat(F.lit('"page_index":0,"source_text":"'), F.regexp_replace("text", "[^A-Za-z ]", " "), F.lit('x"'))
    grant, c = F.lit(',"locator":{"kind":"grant","column":1,"printed_line":5}'), F.col("item_id") % 8
    one = lambda v, e: F.concat(F.lit(f'{{"schema_version":{v},"entries":[{{'), e, F.lit("}]}"))
    j = (
        F.when(c == 0, one(3, F.concat(t, grant))).when(c == 1, F.lit('{"schema_version":2,')).when(c == 2, one(2, F.concat(t, F.lit(',"locator":{"kind":"grant","column":true,"printed_line":5}'))))
        .when(c == 3, one(2, F.concat(t, grant, F.lit(',"box":[0.5,0.1,0.4,0.2]')))).when(c == 4, F.lit('{"schema_version":2,"entries":[]}')).when(c == 5, one(1, F.concat(t, F.lit(',"ref":" 3:14 "'))))
        .when(c == 6, one(2, F.concat(t, F.lit(',"locator":{"kind":"application","paragraph":"0012"}')))).otherwise(one(2, F.concat(t, grant, F.lit(',"box":[0.1,0.1,0.4,0.2]'))))
    )
    files, _ = P.analyzed(table(spark, sf_dir, "benchmark").select("item_id", j.alias("json")), "item_id")
    return files.select("item_id", "reason", "doc_type", "n_entries")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN lpad(CAST(turn AS VARCHAR), 4, '0') END AS marker FROM conversations)
SELECT conv_id, turn, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '0000') AS paragraph FROM m""")
def paragraph_carry(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.when(F.col("role") == "user", F.concat(F.lit("["), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("] "), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("x "), F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.last(T.paragraph_marker(line), ignorenulls=True).over(w), F.lit("0000")).alias("paragraph"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(t, '^[\\[(][0-9]{3,4}[\\])]$')) AS n_markers, CASE WHEN count(*) FILTER (regexp_matches(t, '^[\\[(][0-9]{3,4}[\\])]$')) >= 3 THEN 'application' ELSE 'grant' END AS doc_type FROM w GROUP BY doc_id""")
def marker_doc_type(spark, sf_dir):
    return W.count_markers(table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+", -1)).alias("text")))


@query(f"""WITH {LI}, r AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS y, CAST(10 * l_linenumber + l_partkey % 4 AS INTEGER) AS n FROM li),
a AS (SELECT l_orderkey, list({{'y': y, 'n': n}} ORDER BY y) AS m FROM r WHERE l_linenumber IN (2, 4, 5) GROUP BY 1),
i AS (SELECT r.*, m, coalesce(len(m), 0) AS k, greatest(1, least(len(m) - 1, len(list_filter(m, lambda x: x.y < r.y)))) AS i FROM r LEFT JOIN a USING (l_orderkey))
SELECT l_orderkey, l_linenumber, CAST(greatest(1, CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN m[1].n ELSE round_even(m[i].n + (y - m[i].y) / (m[i + 1].y - m[i].y) * (m[i + 1].n - m[i].n), 0) END) AS INTEGER) AS printed FROM i""")
def interp_lines(spark, sf_dir):
    r = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("y"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 4).cast("int").alias("n"))
    return W.interpolated(r.drop("n"), r.where("l_linenumber in (2, 4, 5)").select("l_orderkey", "y", "n"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "printed")


def _words(spark, sf_dir):
    """Words made of line items: a page an order, a row a pair of line numbers, jittered."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    y = 0.1 + F.floor((n - 1) / 2) * 0.03 + (q % 3) * 0.001  # within the tolerance of a line
    x = 0.1 + ((n - 1) % 2) * 0.3
    return _items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), n.alias("word_ix"), F.concat(F.lit("w"), F.col("l_partkey") % 100).alias("text"), x.alias("x0"), y.alias("y0"), (x + 0.2).alias("x1"), (y + 0.012).alias("y1"), q.cast("double").alias("confidence")
    )


@query(f"""WITH {LI} SELECT l_orderkey AS doc_id, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber)) - 1 AS INTEGER) AS line_ix, string_agg('w' || l_partkey % 100, ' ' ORDER BY l_linenumber) AS text FROM li GROUP BY l_orderkey, (l_linenumber - 1) // 2""")
def line_grouping(spark, sf_dir):
    w = _words(spark, sf_dir)
    text = W.line_text(W.grouped_lines(w), ["doc_id", "page_index", "line_ix"])
    return text.withColumn("line_ix", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line_ix")) - 1).select("doc_id", "line_ix", "text")


@query()
def application_lines(spark, sf_dir):
    return W.application_entries(_words(spark, sf_dir)).select("doc_id", "ordinal", "paragraph", "source_text", "reference_method")


@query()
def callout_match_greedy(spark, sf_dir):
    li = _items(spark, sf_dir)
    x, y = F.col("l_quantity") / 200, F.col("l_discount")
    d = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("104").alias("value"), F.col("l_linenumber").alias("ix"), G.box(x, y, x + 0.3, y + 0.3).alias("box"))
    lab = li.where("l_linenumber < 4").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("104").alias("value"), F.col("l_linenumber").alias("ix"), G.box(x + 0.05, y, x + 0.35, y + 0.3).alias("box"))
    return metrics.callout_score(lab, d).select("doc_id", "matched", "labels", "detected")


@query()
def word_dedupe_greedy(spark, sf_dir):
    w = _words(spark, sf_dir)
    both = w.unionByName(w.where("word_ix % 2 = 0").withColumns({"x0": F.col("x0") + 0.01, "word_ix": F.col("word_ix") + 100, "confidence": F.col("confidence") - 1}))
    return C.merged_words(both).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def align_lines(spark, sf_dir):
    """Turns as printed lines of 60 letters, those of every other turn badly read, against the conversation's whole text."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    lines = c.select("doc_id", "turn", F.posexplode(T.wrapped(F.col("text"), 60)).alias("line", "text"))
    e = lines.select("doc_id", (F.shiftleft(F.col("turn").cast("long"), 32) + F.col("line")).alias("ordinal"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit("e"), F.lit("c"))).alias("source_text"), F.lit(True).alias("flow"))
    clean = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"]), "\n").alias("clean_text"))
    turn, line = F.shiftright("ordinal", 32).cast("int").alias("turn"), F.col("ordinal").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("line")
    return A.aligned(e, clean).select("doc_id", turn, line, "alignment_method", "alignment_score")


@query()
def callout_readings(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.translate((F.col("p_partkey") + 100).cast("string"), "108", "IOB").alias("token"))
    return p.select("p_partkey", "token", F.array_join(C.readings(F.col("token")), ",").alias("readings"))


@query("""WITH RECURSIVE c AS (SELECT conv_id AS doc_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations WHERE text IS NOT NULL),
f AS (SELECT doc_id, k, 0 AS chunk, n AS total FROM c WHERE k = 1 UNION ALL SELECT c.doc_id, c.k, CASE WHEN f.total > 0 AND f.total + c.n > 2000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.total > 0 AND f.total + c.n > 2000 THEN c.n ELSE f.total + c.n END FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, count(*) AS turns FROM f GROUP BY 1, 2""")
def text_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    return N.chunks(c, ["doc_id"], "ordinal").groupBy("doc_id", "chunk").agg(F.count("*").alias("turns"))
