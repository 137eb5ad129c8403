from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import artifacts as A
from tessera.operators import view as V

from .test_layout import WORDS, grant_page, word


def test_segments(spark):
    df = spark.createDataFrame([("Frame (a) frame",), ("none",)], "t string")
    got = [[tuple(s) for s in r[0]] for r in df.select(V.segments(F.col("t"), "frame")).collect()]
    assert got == [[("Frame", True), (" (a) ", False), ("frame", True)], [("none", False)]]
    assert df.select(V.segments(F.col("t"), "(a)")).first()[0][1]["hit"] and not df.select(V.segments(F.col("t"), " ")).first()[0][0]["hit"]


def test_highlights(spark):
    rows = [("d", "highlight", None, json.dumps({"text_ranges": [{"entry_id": "a", "start": 1, "end": 4}, {"entry_id": 5, "start": 1, "end": 2}], "opacity": 0.3})), ("d", "highlight", "#fff", json.dumps({"entry_ids": ["b", 3]})), ("d", "note", None, "{}"), ("d", "highlight", None, "{")]
    got = sorted(tuple(r) for r in V.highlight_ranges(spark.createDataFrame(rows, "doc_id string, kind string, color string, geometry string")).collect())
    assert got == [("d", "a", 1, 4, "#ffe066", 0.3), ("d", "b", 0, V.WHOLE_LINE, "#fff", 0.52)]


def test_points(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.001, 0.0), (0.002, 0.0), (0.0021, 0.0)],), ([(0.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [[p["x"] for p in r[0]] for r in df.select(V.thinned(F.col("p"))).collect()] == [[0.0, 0.002, 0.0021], [0.0]]
    b = G.box(0.1, 0.2, 0.3, 0.6)
    r = spark.range(4).select(G.unrotated(V.rotated(b, F.col("id")), F.col("id")).alias("b")).collect()
    assert all(abs(x - y) < 1e-12 for row in r for x, y in zip(row["b"], (0.1, 0.2, 0.3, 0.6)))


def test_line_at_a_point(spark):
    lines = spark.createDataFrame([("d", 0, "a", 0, (0.1, 0.1, 0.5, 0.12)), ("d", 0, "b", 1, (0.1, 0.14, 0.5, 0.16))], "doc_id string, page_index int, entry_id string, ordinal int, box struct<x0:double,y0:double,x1:double,y1:double>")
    points = spark.createDataFrame([("d", 0, 1, 0.2, 0.131), ("d", 0, 2, 0.9, 0.9)], "doc_id string, page_index int, point_id int, x double, y double")
    assert {r["point_id"]: r["entry_id"] for r in V.line_at(points, lines).collect()} == {1: "b", 2: None}


def test_routing(spark):
    native = spark.createDataFrame(grant_page(0, 1) + [word(1, 0, "x", 0.1, 0.2, 0.5)], WORDS)
    ocr = spark.createDataFrame([word(1, 0, "Sheet", 0.4, 0.45, 0.05), word(1, 1, "1", 0.46, 0.47, 0.05), word(1, 2, "of", 0.48, 0.5, 0.05), word(1, 3, "9", 0.51, 0.52, 0.05), word(1, 4, "104", 0.3, 0.34, 0.5)], WORDS)
    pages = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "doc_id string, page_index int")
    got, words = A.routed_pages(pages, native, ocr)
    assert {r["page_index"]: (r["method"], r["is_drawing"], r["is_sheet"]) for r in got.collect()} == {0: ("native", False, False), 1: ("ocr", True, True), 2: ("native", True, False)}
    assert words.where("page_index = 1").count() == 5


def test_quality(spark):
    pages = spark.createDataFrame([("d", 0, "native", False), ("d", 1, "ocr", True), ("e", 0, "ocr", False)], "doc_id string, page_index int, method string, is_drawing boolean")
    entries = spark.createDataFrame([("d", "interpolated")], "doc_id string, reference_method string")
    none = spark.createDataFrame([], "doc_id string, method string, status string")
    got = {r["doc_id"]: (r["mode"], r["disposition"], r["entry_count"]) for r in A.quality(pages, entries, none, none, none, none, none).collect()}
    assert got == {"d": ("hybrid", "complete_with_warnings", 1), "e": ("ocr", "partial", 0)}


def test_suggestions(spark):
    e = spark.createDataFrame([("d", "a", "the housng 104 is shown in Fig. 3A here", "the housng 104 is shown in Fig. 3A here", None, None, None)], "doc_id string, entry_id string, source_text string, display_text string, alignment_method string, alignment_score double, provider string")
    c = spark.createDataFrame([("d", "a", "nothing like it", 0.99, 0), ("d", "a", "the housing 104 is shown in Fig. 3A here", 0.9, 1)], "doc_id string, entry_id string, corrected_text string, confidence double, position int")
    got = A.corrected(e, c, F.lit("m")).first()
    assert got["display_text"].startswith("the housing") and got["alignment_method"] == "ai_cleanup"
    f = spark.createDataFrame([("d", "a", "Fig. 3A", 0.9), ("d", "a", "Fig. 9", 0.9), ("d", "a", "Fig. 3A", 0.1)], "doc_id string, entry_id string, raw_text string, confidence double")
    assert [tuple(r)[2:] for r in A.suggested_figures(e, f).collect()] == [(27, 34, "Fig. 3A", ["3A"])]
    n = spark.createDataFrame([("d", "a", "104", "housing", 0.9), ("d", "a", "10", "", 0.9)], "doc_id string, entry_id string, value string, component_label string, confidence double")
    assert [tuple(r)[2:] for r in A.suggested_numerals(e, n).collect()] == [("104", "housing", 11, 14)]
