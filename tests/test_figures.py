from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import figures as G

from .test_layout import WORDS, word


def keys(*ids):
    return {G.key_of(i) for i in ids}


def at(**pages):
    return {G.key_of(i): (int(p[1:]), 0.9) for p, ids in pages.items() for i in ids}


def names(found):
    return sorted((p, G.id_of(k)) for p, k, _ in found)


def test_blank_sheets_between_known_ones():
    assert names(G.inferred([1, 2, 3, 4], at(p1=["1"], p4=["4"]), keys("1", "2", "3", "4"))) == [(2, "2"), (3, "3")]
    assert names(G.inferred([1, 2, 3], at(p2=["2"], p3=["3"]), keys("1", "2", "3"))) == [(1, "1")]
    assert names(G.inferred([1, 2, 3], at(p1=["1"], p3=["6"]), keys(*map(str, range(1, 7))))) == [(2, str(i)) for i in (2, 3, 4, 5)]


def test_parts_and_holes():
    assert names(G.inferred([1, 2], at(p1=["9A"], p2=["10"]), keys("9", "9A", "9B", "10"))) == [(1, "9B")]
    assert names(G.inferred([1], at(p1=["2", "5"]), keys("2", "3", "4", "5"))) == [(1, "3"), (1, "4")]
    assert names(G.inferred([1, 2], at(p1=["1"], p2=["4"]), keys("1", "2", "3", "4"))) == [(1, "2"), (1, "3")]
    assert G.inferred([], {}, keys("1")) == [] and G.inferred([1], {}, keys("1")) == []


def test_interleaved_sheets():
    assert names(G.inferred([1, 2, 3, 4], at(p1=["49"], p2=["52", "53"], p4=["54"]), keys(*map(str, range(49, 55))))) == [(2, "50"), (3, "51")]
    assert names(G.inferred([1, 2, 3], at(p1=["2", "4"], p3=["5"]), keys("2", "3", "4", "5"))) == [(2, "3")]


def test_reconciliation():
    assert G.reconciled({"5A", "55", "56", "57", "8"}, {"5B"}) == {"5A", "5B", "8"}
    assert G.reconciled({"5A", "55", "8"}, set()) == {"5A", "55", "8"}
    assert G.reconciled({"3A", "3C"}, {"3T", "7A"}) == {"3A", "3B", "3C"}


def test_loose_ids(spark):
    got = spark.createDataFrame([("l4",), ("sS",), ("??",), ("1 1b",), ("11",), ("",), (None,), ("B",)], "t string").select(G.loose_ids(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [["14"], ["5", "55", "5S"], [], ["118", "11B"], ["11"], [], [], ["8"]]


def test_detection(spark):
    rows = [word(0, 0, "FIG.", 0.4, 0.45, 0.8), word(0, 1, "3A", 0.46, 0.5, 0.8), word(0, 2, "104", 0.2, 0.24, 0.5), word(1, 0, "F1G.", 0.4, 0.45, 0.8, conf=50.0), word(1, 1, "l4", 0.46, 0.5, 0.8, conf=50.0)]
    got = {(r["page_index"], r["figure_id"], r["method"]) for r in G.detected(spark.createDataFrame(rows, WORDS)).collect()}
    assert got == {(0, "3A", "native_text"), (1, "14", "fuzzy_prefix")}


def test_documents(spark):
    f = spark.createDataFrame([("d", "1", 1, 0.9, "spec_exact"), ("d", "3", 3, 0.9, "spec_exact")], "doc_id string, figure_id string, page_index int, score double, method string")
    s = spark.createDataFrame([("d", i) for i in (1, 2, 3)], "doc_id string, page_index int")
    e = spark.createDataFrame([("d", str(i)) for i in (1, 2, 3)], "doc_id string, figure_id string")
    got = {(r["figure_id"], r["page_index"]) for r in G.with_inferred(f, s, e).where("method = 'sequence_inferred'").collect()}
    assert got == {("2", 2)}


def label(i, page, x=0.1, conf=40.0, y=0.1):
    return {"figure_id": i, "page_index": page, "box": {"x0": x, "y0": y, "x1": x + 0.1, "y1": y + 0.03}, "confidence": conf, "forms": [i.replace("O", "0")]}


def test_doubtful_labels_are_read_anew():
    kept = [label("10", 1, conf=95.0), label("12", 3, conf=95.0)]
    want = {"10", "11", "12"}
    assert [(x["figure_id"], i) for x, i in G.recovered([label("20", 2)], kept, want)] == [("20", "11")]
    assert G.recovered([label("20", 2, conf=99.0)], kept, want) == []  # sure enough
    assert G.recovered([label("1O", 1)], kept, want) == []  # the kept label's own spot
    assert G.recovered([], kept, want) == [] and G.recovered([label("20", 2)], [], want) == []


def test_recovered_tables(spark):
    schema = "doc_id string, figure_id string, page_index int, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double, score double, method string"
    row = lambda i, p, c: ("d", i, p, (0.1, 0.1, 0.2, 0.13), c, 0.9, "spec_exact")
    kept = spark.createDataFrame([row("10", 1, 95.0), row("12", 3, 95.0)], schema)
    raw = kept.unionByName(spark.createDataFrame([row("20", 2, 40.0)], schema))
    want = spark.createDataFrame([("d", i) for i in ("10", "11", "12")], "doc_id string, figure_id string")
    got = G.with_recovered(raw, kept, want).where("method = 'spec_sequence_corrected'").collect()
    assert [(r["figure_id"], r["page_index"], r["box"]["x0"], r["score"]) for r in got] == [("11", 2, 0.1, 0.52)]


def test_plans_by_shape_give_the_scores_of_the_rules(spark):
    rnd = random.Random(3)
    sheets, seen, expected, want = [], [], [], set()
    for doc in range(150):
        pages = sorted(rnd.sample(range(9), rnd.randint(1, 8)))
        ids = [f"{n}{s}" for n in range(1, 8) for s in rnd.choice([[""], [""], ["A", "B", "C"]])]
        held = [(rnd.choice(pages), i, rnd.choice([0.2, 0.5, 0.9, 1.4])) for i in ids if rnd.random() < 0.6]
        wanted = [i for i in ids if rnd.random() < 0.8] or ids[:1]
        sheets += [(doc, p) for p in pages]
        expected += [(doc, i) for i in wanted]
        seen += [(doc, i, p, s, "m") for p, i, s in held]
        placed = {}
        for p, i, s in sorted(held, key=lambda x: (x[0], -x[2])):
            placed.setdefault(G.key_of(i), (p, s))
        full = G.reconciled(set(wanted), {G.id_of(k) for k in placed})
        want |= {(doc, G.id_of(k), p, s) for p, k, s in G.inferred(pages, placed, {G.key_of(i) for i in full})}
    G.plan.cache_clear()
    frame = spark.createDataFrame
    got = G.with_inferred(frame(seen, "doc_id int, figure_id string, page_index int, score double, method string"), frame(sheets, "doc_id int, page_index int"), frame(expected, "doc_id int, figure_id string"))
    assert {tuple(r)[:4] for r in got.where("method = 'sequence_inferred'").collect()} == want and len(want) > 100
