from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import align as A
from tessera.operators import mentions as M


def values(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_figure_ranges(spark):
    cases = {"3A-3C": ["3A", "3B", "3C"], "4-6": ["4", "5", "6"], "6-4": [], "3A-4": ["3A", "4"], "1, 2 and 5b": ["1", "2", "5B"], "4 to 6": []}
    got = values(spark, [(k,) for k in cases], M.expand_figures(F.col("t")))
    assert got == list(cases.values())
    assert values(spark, [("4 to 6",), ("1-200",), ("9-7",)], M.expand_figures(F.col("t"), "display")) == [["4", "5", "6"], [], []]


def test_figure_mentions(spark):
    df = spark.createDataFrame([(1, "See FIGS. 2A and 2B, not Fig 7."), (2, None), (3, "configuration 5")], "id int, source_text string")
    got = [tuple(r) for r in M.figure_mentions(df, ["id"]).orderBy("start").collect()]
    assert [(g[0], g[4]) for g in got] == [(1, ["2A", "2B"]), (1, ["7"])]
    assert "See FIGS. 2A and 2B, not Fig 7."[got[0][1] : got[0][2]] == got[0][3]


def test_numerals(spark):
    df = spark.createDataFrame([(1, "a housing 104 and 106, claim 12, in year 1999, length 20 mm, see col 12:5, rod 22A"), (2, "")], "id int, source_text string")
    assert [(r["value"], r["label"]) for r in M.numeral_mentions(df, ["id"]).orderBy("start").collect()] == [("104", "housing"), ("106", "housing"), ("22A", "rod")]


@pytest.mark.parametrize("raw, reason, canonical, display", [
    ("us 7,840,427 b2", None, "US7840427B2", "US 7,840,427 B2"), ("US 2015/0123456", None, "US20150123456A1", "US 2015/0123456 A1"), ("  ", "empty", None, None), (None, "empty", None, None),
    ("D123456 S", "unrecognized", None, None), ("1234567S", "unsupported_kind", None, None), ("123", "ambiguous", None, None), ("2015/123", "invalid_number", None, None), ("7654321C1", "unsupported_kind", None, None),
])
def test_identifiers(spark, raw, reason, canonical, display):
    got = spark.createDataFrame([(raw,)], "t string").select(T.parse_identifier(F.col("t")).alias("p")).first()["p"]
    assert (got["reason"], got["canonical"], got["display"]) == (reason, canonical, display)


def test_gutter(spark):
    assert values(spark, [("15",), ("l5",), ("7",), ("75",), ("O5.",), ("x",)], T.gutter_value(F.col("t"))) == [15, 15, None, None, 5, None]


def test_scalar(spark):
    assert values(spark, [("US12262260B2",), ("US:12262260",), (None,)], T.canonical_id(F.col("t"))) == ["US12262260", "US12262260", ""]
    assert values(spark, [("[0042] Text",), ("(123) x",), ("[12] x",)], T.paragraph_marker(F.col("t"))) == ["0042", "123", None]
    assert values(spark, [("US 7,840,427 B2",), ("none",)], T.short_name(F.col("t"))) == ["’427 patent", "none"]
    assert values(spark, [("12. A device",), ("1.5 mm",), ("x",), ("3.A rod",), ("4.",)], T.claim_candidate(F.col("t"))) == [12, None, None, 3, 4]
    assert values(spark, [("FIELD OF THE INVENTION",), ("SUMMARY",), ("FRAME",), ("A Frame",)], T.is_heading(F.col("t"))) == [True, True, False, False]
    assert values(spark, [("0012",)], T.paragraph_citation(F.col("t"), F.lit("0014"))) == ["¶¶ [0012]–[0014]"]
    assert values(spark, [("3:22",)], T.full_citation(F.col("t"), F.lit("US 7,840,427 B2"))) == ["’427 patent 3:22"]
    assert values(spark, [("#doc=d1&line=9-4",)], T.parse_deep_link(F.col("t"))) == [("d1", 4, 9)]
    assert values(spark, [("https://a.example/x",), ("http://a.example",), ("nonsense",)], T.allowed_url(F.col("t"), ["a.example"])) == [True, False, False]


def test_alignment():
    got = A.align(["the hosng is mountd", "on the frame of the device", "something else entirely here"], "the housing is mounted\non the frame of the device")
    assert [g[1] for g in got] == ["fuzzy", "exact", "unmatched"]
    assert got[0][0] == "the housing is mounted" and got[2][0] == "something else entirely here"
    assert A.align(["kept"], "") == [("kept", "none", 0.0, None)]


def test_clipped_words():
    assert A.is_clipped("transport", "ansport") and not A.is_clipped("transport", "port")
    assert A.is_clipped("Interface", "ace", True) and not A.is_clipped("abc", "abc", True)
    assert A.without_overlap("the transport", "ansport layer") == "layer"
    assert A.without_overlap("the transport", "layer") == "layer"


def test_identity(spark):
    df = spark.createDataFrame([("US1234567B2", "US:1234567", "a", "b"), ("US1234567", "US7", "a", "b"), (None, "US7", "A title", "a title "), (None, None, None, "x")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(A.identity(*[F.col(c) for c in "abcd"])).collect()] == ["verified", "mismatch", "probable", "insufficient"]
