from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import records as R

from .test_layout import WORDS, word


def test_annotations(spark):
    box = {"x0": 0.1, "y0": 0.1, "x1": 0.5, "y1": 0.2}
    cases = [
        ("note", {"x": 0.1, "y": 1}, None), ("note", {"x": True, "y": 0.1}, "point"), ("note", {"x": 0.1, "y": 0.1, "collapsed": 1}, "collapsed"), ("bookmark", {"x": 0.1, "y": 0.1, "width": 2}, "size"),
        ("note", {"x": 0.1, "y": 0.1, "version": 3}, "version"), ("note", {"x": 0.1, "y": 0.1, "opacity": 0.05}, "opacity"), ("highlight", box, None), ("highlight", {**box, "x1": 0.1}, "area"), ("highlight", {"x0": 0}, "box"),
        ("highlight", {**box, "rects": [[0, 0, 1, 1]]}, None), ("highlight", {**box, "rects": [[0, 0, 0, 1]]}, "rects"), ("highlight", {**box, "text_ranges": [{"entry_id": "a", "start": 0, "end": 0}]}, None),
        ("highlight", {**box, "text_ranges": [{"entry_id": 1, "start": 0, "end": 0}]}, "text_ranges"), ("drawing", {"points": [[0, 0], [1, 1]]}, None), ("drawing", {"points": [[0, 0]]}, "points"), ("drawing", {"points": [[0, 0], [1, 2]]}, "pairs"), ("drawing", {"points": [[0, 0], [1, 1]], "stroke_width": 1}, "stroke"),
    ]
    df = spark.createDataFrame([(i, k, json.dumps(g)) for i, (k, g, _) in enumerate(cases)], "i int, k string, g string")
    got = [r[0] for r in df.orderBy("i").select(R.annotation_problem(F.col("k"), F.col("g"))).collect()]
    assert got == [c[2] for c in cases]
    assert spark.range(1).select(R.annotation_problem(F.lit("note"), F.lit("{"))).first()[0] == "json"
    assert spark.range(1).select(R.highlight_rects(F.lit(json.dumps(box))), R.highlight_rects(F.lit("{}"))).first()[:] == ([[0.1, 0.1, 0.5, 0.2]], [])


def test_values(spark):
    one = spark.range(1)
    assert one.select(R.claim_numbers_valid(F.array(F.lit(0), F.lit(5), F.lit(1000)))).first()[0] == [5]
    assert one.select(R.display_number(F.lit("US7840427B2")), R.display_number(F.lit("odd"))).first()[:] == ("US 7,840,427 B2", "odd")
    assert one.select(R.workspace_name(F.lit("  a \n b ")), R.workspace_name(F.lit(" ")), R.workspace_name(F.lit("x" * 121))).first()[:] == ("a b", None, None)
    assert [r["disposition"] for r in R.published(spark.createDataFrame([("partial",), ("odd",), (None,)], "disposition string")).collect()] == ["partial", "complete_with_warnings", "complete_with_warnings"]


def test_joins(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "job_id int, document_id string")
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, source_id int")
    src = spark.createDataFrame([(1, "fetch", None), (2, "upload", None)], "source_id int, source_type string, pdf_object_key string")
    assert [r["job_id"] for r in R.needs_fetch(jobs, docs, src).collect()] == [1]
    f = "doc_id string, page_index int, figure_id string, method string"
    got = R.completed_drawings(spark.createDataFrame([("d", 0, "1", "x")], f), spark.createDataFrame([("d", 0, "9", "ocr"), ("d", 1, "2", "ocr")], f))
    assert sorted((r["page_index"], r["figure_id"], r["method"]) for r in got.collect()) == [(0, "1", "native_text"), (1, "2", "ocr")]
    assert [r["v"] for r in R.last_labels(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, p int, v string"), ["k"], "p").collect()] == ["b"]


def test_columns(spark):
    rows = [word(0, i, "x", 0.1 + 0.5 * (i % 2), 0.4 + 0.5 * (i % 2), 0.1 + i * 0.03) for i in range(24)] + [word(1, i, "x", 0.1 + 0.5 * (i % 2), 0.3 + 0.5 * (i % 2), 0.1) for i in range(4)] + [word(2, 0, "x", 0.1, 0.9, 0.2)]
    got = {r["page_index"]: round(r["boundary"], 3) for r in R.column_boundary(spark.createDataFrame(rows, WORDS)).collect()}
    assert got[1] == 0.45 and 0.4 < got[0] < 0.6 and 2 not in got


def test_otsu(spark):
    h = spark.createDataFrame([("a", 10, 50), ("a", 12, 50), ("a", 200, 30), ("a", 210, 40)], "k string, level int, n int")
    assert R.otsu(h, ["k"]).first()["threshold"] == 12
