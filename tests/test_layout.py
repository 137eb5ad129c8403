from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import callouts as C
from tessera.operators import lines as W
from tessera.operators import metrics as S

WORDS = "doc_id string, page_index int, word_ix int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, is_bold boolean"


def word(page, ix, text, x0, x1, cy, h=0.008, conf=None, bold=None, doc="d"):
    return (doc, page, ix, text, x0, cy - h, x1, cy + h, conf, bold)


def grant_page(page, left, rows=15, header=True):
    out = [word(page, 0, str(left), 0.28, 0.30, 0.0535), word(page, 1, str(left + 1), 0.70, 0.72, 0.0535)] if header else []
    for i in range(rows):
        cy = 0.11 + 0.025 * i
        for text, a, b in (("The", 0.12, 0.30), ("housing", 0.32, 0.44), ("right", 0.55, 0.72), ("side", 0.74, 0.88)):
            out.append(word(page, len(out) + 10, text, a, b, cy))
        if (i + 1) % 5 == 0:
            out.append(word(page, len(out) + 10, str(i + 1), 0.49, 0.51, cy))
    return out


def test_grant_lines(spark):
    df = spark.createDataFrame(grant_page(0, 1) + grant_page(1, 3, header=False), WORDS)
    got = [tuple(r) for r in W.grant_entries(df).select("page_index", "column", "printed_line", "source_text", "reference_method", "ordinal").orderBy("ordinal").collect()]
    assert [g[:4] for g in got[:15]] == [(0, 1, i + 1, "The housing") for i in range(15)]
    assert [g[:4] for g in got[15:30]] == [(0, 2, i + 1, "right side") for i in range(15)]
    assert {g[1] for g in got[30:]} == {3, 4} and [g[5] for g in got] == list(range(60))
    assert got[4][4] == "detected" and got[5][4] == "interpolated"


def test_no_specification_page(spark):
    assert W.grant_entries(spark.createDataFrame([word(0, i, "x", 0.1 * i, 0.1 * i + 0.05, 0.3) for i in range(5)], WORDS)).count() == 0


def test_application_paragraphs(spark):
    rows = [word(0, 0, "before", 0.1, 0.2, 0.2), word(0, 1, "[0001]", 0.1, 0.2, 0.3), word(0, 2, "text", 0.22, 0.3, 0.3), word(0, 3, "[0002]", 0.1, 0.2, 0.4), word(1, 0, "more", 0.1, 0.2, 0.2)]
    got = [tuple(r) for r in W.application_entries(spark.createDataFrame(rows, WORDS)).select("paragraph", "source_text", "reference_method").orderBy("ordinal").collect()]
    assert got == [("0000", "before", "none"), ("0001", "text", "detected"), ("0002", "more", "interpolated")]


def test_interpolation_rounds_half_even():
    assert W.printed_line([(0.0, 1), (1.0, 2)], 0.5) == 2 and W.printed_line([(0.0, 2), (1.0, 3)], 0.5) == 2
    assert W.printed_line([(0.2, 10), (0.4, 20)], 0.1) == 5 and W.printed_line([], 0.3) == 1
    assert W.progression([(0.1, 5), (0.2, 10), (0.25, 12), (0.3, 15), (0.4, 40)]) == [(0.1, 5), (0.2, 10), (0.3, 15)]


def test_line_numbers_follow_the_mean():
    assert W.line_numbers(np.array([0.1, 0.104, 0.108, 0.2]), np.arange(4.0), np.full(4, 0.01)).tolist() == [0, 0, 0, 1]


def test_geometry(spark):
    a, b = G.box(0.0, 0.0, 0.5, 0.5), G.box(0.25, 0.25, 0.75, 0.75)
    r = spark.range(1).select(G.iou(a, b).alias("i"), G.containment(a, b).alias("c"), G.iou(a, G.box(0.6, 0.6, 0.7, 0.7)).alias("z"), G.safe(G.box(100.0, 100.0, 500.0, 900.0)).alias("s"), G.unrotated(G.unrotated(b, F.lit(1)), F.lit(3)).alias("u"), G.is_valid(G.box(0.5, 0.0, 0.4, 1.0)).alias("v")).first()
    assert abs(r["i"] - 1 / 7) < 1e-12 and r["c"] == 0.25 and r["z"] == 0.0 and tuple(r["s"]) == (0.1, 0.1, 0.5, 0.9) and tuple(r["u"]) == (0.25, 0.25, 0.75, 0.75) and r["v"] is False


def test_callouts(spark):
    words = spark.createDataFrame([word(0, 0, "104", 0.2, 0.24, 0.5, conf=90.0), word(0, 1, "1O6", 0.4, 0.44, 0.5, conf=60.0), word(0, 2, "2019", 0.6, 0.64, 0.5, conf=95.0), word(0, 3, "3", 0.8, 0.82, 0.9)], WORDS)
    figures = spark.createDataFrame([], "doc_id string, page_index int, box struct<x0:double,y0:double,x1:double,y1:double>")
    found = C.detected(words, figures)
    support = spark.createDataFrame([("d", "104", 1.0), ("d", "106", 0.72)], "doc_id string, value string, support double")
    got = {r["value"]: r["method"] for r in C.chosen(found, support).collect()}
    assert got == {"104": "spec_exact", "106": "spec_fuzzy"}


def test_greedy_matches(spark):
    box = lambda x: {"x0": x, "y0": 0.1, "x1": x + 0.2, "y1": 0.2}
    schema = "doc_id string, value string, page_index int, ix int, box struct<x0:double,y0:double,x1:double,y1:double>"
    lab = spark.createDataFrame([("d", "1", 0, 0, box(0.1)), ("d", "1", 0, 1, box(0.12))], schema)
    det = spark.createDataFrame([("d", "1", 0, 0, box(0.1)), ("d", "1", 0, 1, box(0.9)), ("d", "1", 0, 2, box(0.1))], schema)
    assert sorted((r["label_ix"], r["detected_ix"]) for r in S.greedy_matches(lab, det).collect()) == [(0, 2), (1, 0)]


def test_sequence():
    assert C.sequence([(1, (1, 0), 0.9), (2, (9, 0), 0.9), (3, (2, 0), 0.9), (4, (3, 0), 0.9)]) == {(1, (1, 0)), (3, (2, 0)), (4, (3, 0))}
    assert C.sequence([]) == set()


def test_readings_of_one_place(spark):
    rows = [word(0, 0, "terface", 0.22, 0.30, 0.5, conf=90.0), word(0, 1, "interface", 0.20, 0.30, 0.5, conf=80.0), word(0, 2, "104", 0.5, 0.54, 0.5, conf=50.0), word(0, 3, "104", 0.501, 0.541, 0.5, conf=60.0)]
    df = spark.createDataFrame(rows, WORDS)
    assert sorted(r["text"] for r in C.merged_words(df).collect()) == ["104", "interface"]
    assert {r["text"]: r["confidence"] for r in C.fused_words(df).collect()} == {"terface": 90.0, "interface": 80.0, "104": 62.0}


def test_callouts_are_read_by_themselves(spark):
    """Rows that repeat an id do not lend each other their readings; support is given once a value, null values none."""
    box = lambda x: {"x0": x, "y0": 0.1, "x1": x + 0.02, "y1": 0.12}
    schema = "doc_id string, page_index int, callout_id string, value string, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double"
    rows = spark.createDataFrame([("d", 0, "c", "104", box(0.1), 95.0), ("d", 0, "c", "206", box(0.5), 95.0), ("e", 0, "c", "104", box(0.1), 95.0)], schema)
    support = spark.createDataFrame([("d", "104", 1.0), ("d", "104", 1.0), ("d", None, 1.0), (None, "206", 1.0), ("e", "1042", 0.8)], "doc_id string, value string, support double")
    got = {(r["doc_id"], r["value"], r["method"]) for r in C.chosen(rows, support).collect()}
    assert got == {("d", "104", "spec_exact"), ("d", "206", "drawing_only"), ("e", "1042", "spec_fuzzy")}


def test_line_text_without_tabs_needs_no_window(spark):
    words = spark.createDataFrame([word(0, 1, "b", 0.4, 0.44, 0.5), word(0, 0, "a", 0.2, 0.24, 0.5)], WORDS).withColumn("line_ix", F.lit(0))
    text = W.line_text(words, ["doc_id", "line_ix"])
    assert "Window" not in text._jdf.queryExecution().optimizedPlan().toString() and [r["text"] for r in text.collect()] == ["a b"]
