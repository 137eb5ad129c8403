"""Queries without SQL, over whole tables, against plain versions of what they say."""

from __future__ import annotations

import itertools
import math
import re
from difflib import SequenceMatcher

import pandas as pd
import pytest

from tessera.plans import documents, reading

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items():
    li = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"])
    return li.astype(float).groupby(["l_orderkey", "l_linenumber"], as_index=False).min()


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def test_labels_take_detections_in_order(spark, items):
    want = {}
    for order, rows in items.groupby("l_orderkey"):
        at = [(int(r.l_linenumber), r.l_quantity / 200, r.l_discount) for r in rows.itertuples()]
        labels = [(i, (x + 0.05, y, x + 0.35, y + 0.3)) for i, x, y in at if i < 4]
        free = {i: (x, y, x + 0.3, y + 0.3) for i, x, y in at}
        n = 0
        for _, box in sorted(labels):
            best = max(((overlap(box, b), i) for i, b in free.items() if overlap(box, b) >= 0.3), default=None)
            if best:
                n += 1
                del free[best[1]]
        if labels:
            want[int(order)] = (n, len(labels), len(at))
    got = {r["doc_id"]: (r["matched"], r["labels"], r["detected"]) for r in documents.callout_match_greedy(spark, SF).collect()}
    assert {k: v for k, v in got.items() if v[1]} == want


def test_points_of_strokes(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"])
    want = {}
    for i, v in zip(e["vec_id"], e["embedding"]):
        pts = [(k / 1000.0, float(y) / 100) for k, y in enumerate(v)]
        kept = pts[:1]
        for p in pts[1:-1]:
            if math.hypot(p[0] - kept[-1][0], p[1] - kept[-1][1]) >= 0.0015:
                kept.append(p)
        want[i] = len(kept) + (len(pts) > 1)
    assert {r["vec_id"]: r["n"] for r in reading.stroke_points(spark, SF).collect()} == want


def plain_readings(token):
    digit = dict(zip("ILOQSBZ", "1100582"))
    fixed = lambda t: "".join(digit.get(c, c) for c in t)
    numeral = lambda t: re.fullmatch("[0-9]{2,4}[A-Z]?", t) and not re.fullmatch("(19|20)[0-9]{2}", t)
    out = set()
    for run in re.findall(r"(?<![A-Z0-9])[0-9ILOQSBZ]{2,4}[A-Z]?(?![A-Z0-9])", token.strip().upper()):
        if not re.search("[0-9]", run):
            continue
        out |= {run} if numeral(run) else set()
        whole, ends = fixed(run), fixed(run[:-1]) + run[-1]
        out |= {whole} if re.fullmatch("[0-9]{2,4}", whole) and numeral(whole) else set()
        out |= {ends} if len(run) >= 3 and run[-1].isalpha() and numeral(ends) and not re.match("(19|20)[0-9]{2}", ends) else set()
    return ",".join(sorted(out))


def test_readings_of_numerals(spark):
    keys = pd.read_parquet(f"{SF}/part.parquet", columns=["p_partkey"])["p_partkey"]
    want = {int(k): plain_readings(str(k + 100).translate(str.maketrans("108", "IOB"))) for k in keys}
    assert {r["p_partkey"]: r["readings"] for r in documents.callout_readings(spark, SF).collect()} == want


def test_verdicts_on_identity(spark):
    b = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = {}
    for i, t in zip(b["item_id"], b["text"]):
        i = int(i)
        source, found = (f"US{i + 100000}" if i % 3 else ""), ("" if i % 3 == 0 else f"US{i + 100000}" if i % 3 == 1 else f"US{i}")
        other = t.upper() if i % 2 == 0 else t[:20]
        alike = SequenceMatcher(None, t.lower().strip(), other.lower().strip()).ratio() if t and other else 0.0
        want[i] = ("verified" if source == found else "mismatch") if source and found else "probable" if alike >= 0.9 else "insufficient"
    assert {r["item_id"]: r["status"] for r in documents.identity_verdict(spark, SF).collect()} == want
    assert len(set(want.values())) > 2


def test_runs_of_figures(spark, items):
    """The longest rising run by trying all of them, on the documents of few labels."""
    got = {}
    for r in reading.figure_sequence(spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["page_index"], int(r["figure_id"]), r["score"], r["in_sequence"]))
    tried = 0
    for rows in got.values():
        nodes = {}
        for p, n, s, _ in rows:
            nodes[p, n] = max(s, nodes.get((p, n), 0.0))
        order = sorted(nodes)
        runs = [c for k in range(1, len(order) + 1) for c in itertools.combinations(order, k) if all(a[0] <= b[0] and a[1] < b[1] for a, b in itertools.pairwise(c))]
        longest = max(map(len, runs))
        marked = tuple(sorted({(p, n) for p, n, _, inside in rows if inside}))
        assert marked in runs and len(marked) == longest
        ends = min((c[-1][1], c[-1][0]) for c in runs if len(c) == longest)
        assert (marked[-1][1], marked[-1][0]) == ends
        tried += 1
    assert tried == items["l_orderkey"].nunique()
