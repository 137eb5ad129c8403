"""Choices in rounds, grids, counted medians, carried columns and scores anew, each against the plain rule gone through one by one."""

from __future__ import annotations

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import callouts as C
from tessera.operators import lines as W
from tessera.operators import mentions as M
from tessera.operators import metrics as S
from tessera.operators import rounds as R


def box(x, y, w, h):
    return {"x0": x, "y0": y, "x1": x + w, "y1": y + h}


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_taken_in_turn(spark):
    rnd = random.Random(1)
    pairs = [(d, a, b, rnd.choice([0.3, 0.5, 0.5, 0.9])) for d in range(6) for a in range(rnd.randint(1, 9)) for b in range(9) if rnd.random() < 0.5]
    want, taken = set(), set()
    for d, a in sorted({p[:2] for p in pairs}):
        free = [(w, b) for e, c, b, w in pairs if (e, c) == (d, a) and (d, b) not in taken]
        if free:
            want.add((d, a, max(free)[1]))
            taken.add((d, max(free)[1]))
    df = spark.createDataFrame(pairs, "doc_id int, a int, b int, w double")
    got = R.taken_in_turn(df, ["doc_id"], "a", "b", "w")
    assert {(r["doc_id"], r["a"], r["b"]) for r in got.collect()} == want and len(want) > 20
    assert R.taken_in_turn(df.where("false"), ["doc_id"], "a", "b", "w").count() == 0


@pytest.mark.parametrize("size", [0.01, 0.2])
def test_one_a_spot(spark, size):
    rnd = random.Random(2)
    rows = [(d, i, rnd.choice([0.5, 0.7, 0.9]), box(round(rnd.random() * 0.3, 3), round(rnd.random() * 0.3, 3), size * rnd.random(), size)) for d in range(3) for i in range(120)]

    def near(a, b):
        w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
        inter = max(w, 0) * max(h, 0)
        union = sum((x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (a, b)) - inter
        cx, cy = ((a["x0"] + a["x1"]) - (b["x0"] + b["x1"])) / 2, ((a["y0"] + a["y1"]) - (b["y0"] + b["y1"])) / 2
        return (inter > 0 and inter / union >= 0.25) or math.hypot(cx, cy) <= 0.008

    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if not any(k[0] == r[0] and near(k[3], r[3]) for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, f"doc_id int, i int, s double, box {BOX}")
    got = R.one_a_spot(df, ["doc_id"], "i", [-F.col("s"), F.col("i")])
    assert {(r["doc_id"], r["i"]) for r in got.collect()} == {r[:2] for r in kept} and len(kept) < len(rows)
    assert R.one_a_spot(df.where("false"), ["doc_id"], "i", [F.col("i")]).count() == 0


def test_nearest(spark):
    rnd = random.Random(3)
    grid = lambda: rnd.choice([round(rnd.random(), 2), rnd.random() ** 4])
    places = [(d, grid(), grid(), f"p{i}", i) for d, n in ((0, 1), (1, 4), (2, 400), (3, 60)) for i in range(n)] + [(3, 0.5, 0.5, f"q{i}", 100 + i) for i in range(50)]
    points = [(d, i, rnd.uniform(-0.5, 1.5) if rnd.random() < 0.3 else grid(), grid()) for d in range(5) for i in range(150)]
    want = {}
    for d, i, x, y in points:
        near = min(((math.hypot(x - px, y - py), pos, p) for e, px, py, p, pos in places if e == d), default=None)
        if near:
            want[d, i] = near[2]
    got = R.nearest(spark.createDataFrame(points, "k int, i int, x double, y double"), spark.createDataFrame(places, "k int, x double, y double, place string, position int"), ["k"], "i")
    assert {(r["k"], r["i"]): r["place"] for r in got.collect()} == want


def test_equally_far_places_go_by_position(spark):
    at = lambda k, b: (k % 97 / 100.0, k % b / 100.0)
    places = [(1, *at(k, 83), str(k), k) for k in (888, 895, 504, 682, 199, 203)]
    points = [(1, k, *at(k, 89)) for k in (4868, 10769, 4570)]
    want = {i: min((math.sqrt((x - px) ** 2 + (y - py) ** 2), pos, p) for _, px, py, p, pos in places)[2] for _, i, x, y in points}
    got = R.nearest(spark.createDataFrame(points, "k int, i int, x double, y double"), spark.createDataFrame(places, "k int, x double, y double, place string, position int"), ["k"], "i")
    assert {r["i"]: r["place"] for r in got.collect()} == want


def test_named_figures_come_first(spark):
    c = spark.createDataFrame([("d", 0, "c1", "fig. 2", box(0.1, 0.1, 0.1, 0.1)), ("d", 0, "c2", None, box(0.1, 0.1, 0.1, 0.1)), ("d", 1, "c3", "x", box(0.1, 0.1, 0.1, 0.1))], f"doc_id string, page_index int, callout_id string, figure_id string, box {BOX}")
    f = spark.createDataFrame([("d", 0, "FIG. 1", box(0.1, 0.1, 0.1, 0.1), 0), ("d", 0, "FIG. 2", box(0.8, 0.8, 0.1, 0.1), 1)], f"doc_id string, page_index int, figure_id string, box {BOX}, position int")
    assert {r["callout_id"]: r["figure_id"] for r in M.nearest_figure(c, f).collect()} == {"c1": "FIG. 2", "c2": "FIG. 1", "c3": "x"}


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_exact_median(spark, bins):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([rnd.random(), 0.5, -1e300, 1e300, 1e-308])) for k in "abc" for _ in range(rnd.randint(1, 400))] + [("d", 7.0), ("e", 1.0), ("e", 2.0), (None, 3.0), ("f", None), ("a", math.nan)]
    want = {k: statistics.median(v for j, v in rows if j == k and v is not None and v == v) for k in ("a", "b", "c", "d", "e", None)}
    got = {r["k"]: r["median"] for r in R.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", bins).collect()}
    assert got == pytest.approx(want, rel=1e-15)


def test_columns_carry_over_pages(spark):
    rnd = random.Random(5)
    pages, want = [], {}
    for d in range(20):
        carried = None
        for p in range(2000 if d == 0 else 30):
            own, counts = rnd.choice([None, None, rnd.randint(1, 60), 2 * p + 1]), rnd.random() < 0.8
            pages.append((d, p, own, counts))
            left = own if own is not None and not (carried and own < carried) else carried or 1
            want[d, p] = left
            carried = left + 2 if counts else carried
    got = W.carried_columns(spark.createDataFrame(pages, "doc_id int, page_index int, own int, counts boolean").repartition(4))
    assert {(r["doc_id"], r["page_index"]): r["column"] for r in got.collect()} == want


def plain_rescored(rows):
    key = lambda f: (int("".join(c for c in f if c.isdigit())), ord(f[-1]) - 64 if f[-1].isalpha() else 0) if f[:1].isdigit() else None
    out = []
    run = [(r[0], r[1], key(r[2])) for r in rows if r[5] and key(r[2])]
    for d, page, f, s, m, inside in rows:
        if key(f) is None:
            out.append((d, page, f, s, m, inside))
            continue
        before = max((k for e, p, k in run if e == d and p < page), default=None)
        after = min((k for e, p, k in run if e == d and p > page), default=None)
        off = max(0, before[0] - key(f)[0] if before and key(f) < before else 0, key(f)[0] - after[0] if after and key(f) > after else 0)
        new = min(1.0, max(0.0, (s or 0.0) + (0.04 if inside else -0.04 if off <= 2 else -0.20)))
        if new >= (0.34 if m.startswith("spec_") else 0.70):
            out.append((d, page, f, round(new, 3), m, inside))
    held = {(r[0], r[2]) for r in out if r[5] and key(r[2])}
    return [r for r in out if (r[0], r[2]) not in held or (r[5] and key(r[2]))]


def test_rescored_figures(spark):
    rnd = random.Random(6)
    rows = [(d, p, rnd.choice(["1", "2", "3A", "4", "9", "40", "x"]), rnd.choice([0.2, 0.36, 0.5, 0.72, 0.9, None]), rnd.choice(["spec_exact", "drawing_only"]), rnd.random() < 0.4) for d in range(8) for p in range(6) for _ in range(3)]
    got = C.rescored_figures(spark.createDataFrame(rows, "doc_id int, page_index int, figure_id string, score double, method string, in_sequence boolean"))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain_rescored(rows))


def test_last_label_counts(spark):
    labels = spark.createDataFrame([("d", 1, 3, 5, 0), ("d", 1, 3, 7, 1)], "doc_id string, ordinal int, column int, line int, position int")
    got = S.reference_score(labels, spark.createDataFrame([("d", 1, 3, 7)], "doc_id string, ordinal int, column int, line int")).first()
    assert (got["den"], got["exact"]) == (1, 1)


def test_pairs_meet_in_one_cell(spark):
    rnd = random.Random(7)
    rows = [(0, i, box(rnd.random(), rnd.random(), rnd.random() / 3, rnd.random() / 3)) for i in range(150)]
    want = {(a, b) for _, a, p in rows for _, b, q in rows if a < b and p["x0"] <= q["x1"] and q["x0"] <= p["x1"] and p["y0"] <= q["y1"] and q["y0"] <= p["y1"]}
    got = [(r["a"], r["b"]) for r in R.near_pairs(spark.createDataFrame(rows, f"k int, i int, box {BOX}"), ["k"], "i").collect()]
    assert len(got) == len(set(got)) and set(got) == want
