from __future__ import annotations

import math
import random

from tessera.operators import callouts as C
from tessera.operators import lines as W

WORDS = "doc_id int, page_index int, word_ix int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def plan(df):
    return df._jdf.queryExecution().toString()


def chain(labels):
    """The run as it is stated, each label looking at all before it."""
    best = {}
    for page, key, s in labels:
        best[page, key] = max(s, best.get((page, key), 0.0))
    nodes, ends = sorted(best), []
    for i, (page, key) in enumerate(nodes):
        n, w, j = max([(ends[j][0], ends[j][1], -j) for j in range(i) if nodes[j][1] < key], default=(0, 0, 1))
        ends.append((n + 1, w + best[page, key], -j))
    i = max(range(len(nodes)), key=lambda k: (ends[k][0], tuple(-x for x in nodes[k][1]), -nodes[k][0], ends[k][1]), default=-1)
    out = set()
    while i >= 0:
        out.add(nodes[i])
        i = ends[i][2]
    return out


def test_sequences_of_many_labels(spark):
    rnd = random.Random(1)
    for n in (0, 1, 5, 60, 300):
        for _ in range(20):
            labels = [(rnd.randint(0, 20), (rnd.randint(1, 25), rnd.randint(0, 2)), rnd.randint(0, 4) / 4) for _ in range(n)]
            assert C.sequence(labels) == chain(labels)
    many = [(i, (rnd.randint(1, 9000), 0), 0.5) for i in range(20_000)]
    assert len(C.sequence(many)) > 200  # each looking at all before it took minutes
    rows = [(d, p, str(rnd.randint(1, 9)), 0.5) for d in (1, 2, None) for p in range(5)] + [(3, 0, "x", None)]
    f = spark.createDataFrame(rows, "doc_id int, page_index int, figure_id string, score double")
    got = C.sequenced_figures(f)
    assert "FlatMapGroupsInPandas" not in plan(got) and got.count() == len(rows)
    for d in (1, 2, None):
        held = chain([(p, (int(i), 0), s) for e, p, i, s in rows if e == d and i != "x"])
        assert {(r["page_index"], r["figure_id"]) for r in got.where(f"doc_id <=> {'null' if d is None else d}").collect() if r["in_sequence"]} == {(p, str(k[0])) for p, k in held}


def merged(rows):
    """Each word against all that are kept."""
    rank = lambda w: (sum(c.isalnum() for c in w[3]), max(0.0, w[6] - w[4]), w[8] or 0.0)
    box = lambda w: dict(zip(("x0", "y0", "x1", "y1"), w[4:8]))
    cy = lambda w: (w[5] + w[7]) / 2
    kept = []
    for w in sorted(rows, key=lambda w: (-(w[8] or 0.0), cy(w), w[4], w[2])):
        for n, k in enumerate(kept):
            if (k[3].strip().casefold() == w[3].strip().casefold() and C._near(box(k), box(w))) or (abs(cy(k) - cy(w)) <= 0.008 and C._within(box(k), box(w)) >= 0.82 and abs(k[6] - w[6]) <= 0.008):
                if rank(w) > rank(k):
                    kept[n] = w
                break
        else:
            kept.append(w)
    return kept


def test_words_merge_as_if_each_saw_all(spark):
    rnd = random.Random(2)
    rows = []
    for p in range(8):
        for i in range(200):
            x, y = rnd.random() * 0.3, rnd.random() * 0.1
            rows.append((1, p, i, rnd.choice(["a", "ab", "A", "abc", "b"]), x, y, x + rnd.random() * 0.05, y + 0.01, rnd.choice([None, 50.0, 80.0, 90.0])))
    got = C.merged_words(spark.createDataFrame(rows, WORDS))
    assert "FlatMapGroupsInPandas" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {w for p in range(8) for w in merged([r for r in rows if r[1] == p])}
    odd = spark.createDataFrame([(1, 0, 0, "a", None, 0.1, 0.2, 0.2, 1.0), (1, 0, 1, "a", 0.1, 0.1, math.nan, 0.2, 1.0)], WORDS)
    assert C.merged_words(odd).count() == 2 and C.fused_words(odd).count() == 2


def test_anchors_are_not_carried_whole(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.0)], "k int, y double")
    anchors = spark.createDataFrame([(1, float(i), i) for i in range(50)], "k int, y double, n int")
    got = W.interpolated(rows, anchors, ["k"])
    assert "collect_list" not in plan(got) and {(r["k"], r["printed"]) for r in got.collect()} == {(1, 1), (2, 1)}


def test_pages_are_read_as_plain_rows():
    first = {"own": 3, "marks": None, "header_y": 0.06, "gutter_x": None, "lo": None, "hi": None}
    word = lambda i, t, x, y: {"word_ix": i, "text": t, "x0": x, "y0": y, "x1": x + 0.1, "y1": y + 0.01, "confidence": None, **first}
    got = W._read_page([word(0, "a", 0.1, 0.2), word(1, "b", 0.25, 0.2), word(2, "c", 0.6, 0.2), {**word(3, "d", 0.1, 0.3), "x0": None}], "native")
    assert [(r[0], r[4]) for r in got] == [(0, "a b"), (1, "c")]
