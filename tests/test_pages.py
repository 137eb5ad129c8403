"""Pages read all at once against a plain reading of each page by itself."""

from __future__ import annotations

import random
from statistics import median

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import lines as W


def printed_line(anchors: list[tuple[float, int]], y: float) -> int:
    """The line at a height: linear between the anchors around it and beyond the outer ones, half-even, at least 1."""
    if len(anchors) < 2:
        return max(1, anchors[0][1]) if anchors else 1
    i = min(max(int(np.searchsorted([a[0] for a in anchors], y, side="left")) - 1, 0), len(anchors) - 2)
    (y0, n0), (y1, n1) = anchors[i], anchors[i + 1]
    return max(1, n0 if y1 == y0 else round(n0 + (y - y0) / (y1 - y0) * (n1 - n0)))


def mean(values: list[float]) -> float:
    return float(np.array(values).sum() / len(values))


def read_page(words: list[dict], method: str) -> list[tuple]:
    """The lines of a page (as READ): none of a page that has neither a column pair nor three line numbers that rise evenly."""
    first = words[0]
    anchors = W.progression([(m["cy"], int(m["n"])) for m in first["marks"] or ()])
    if first["own"] is None and len(anchors) < 3:
        return []
    start = first["header_y"] + W.HEADER_PAD
    middle, lo, hi = first["gutter_x"], first["lo"], first["hi"]
    if len(anchors) < 2:
        anchors, middle, lo, hi = [(start, 1), (0.94, W.LINES_PER_COLUMN)], 0.5, -1.0, -1.0
    sides: tuple[list[dict], list[dict]] = ([], [])
    for w in words:
        if any(w[e] is None for e in ("x0", "y0", "x1", "y1")):
            continue
        cx, cy = (w["x0"] + w["x1"]) / 2, (w["y0"] + w["y1"]) / 2
        if start < cy <= W.CONTENT_BOTTOM and (cx < middle - 0.005 or cx > middle + 0.005):
            sides[cx > middle].append({**w, "cx": cx, "cy": cy})
    out: list[tuple] = []
    for side, part in enumerate(sides):
        read_column(side, part, anchors, start, lo, hi, method, out)
    return out


def read_column(side, words, anchors, start, lo, hi, method, out) -> None:
    if not words:
        return
    number = W.line_numbers(*(np.array(v) for v in zip(*((w["cy"], w["x0"], w["y1"] - w["y0"]) for w in words)))).tolist()
    parts: dict[int, list[dict]] = {}
    for n, w in zip(number, words):
        parts.setdefault(n, []).append(w)
    lines = []
    for n in sorted(parts):
        y = mean([w["cy"] for w in parts[n]])
        ws = sorted((w for w in parts[n] if not lo <= w["cx"] <= hi), key=lambda w: w["x0"])
        text = join_words([w["text"] for w in ws], [w["x0"] for w in ws], [w["x1"] for w in ws], method == "ocr")
        if y >= start and text and not (len(ws) == 1 and text.strip().rstrip(".").isdigit() and len(text.strip().rstrip(".")) <= 3):
            lines.append((y, ws, text))
    gaps = [b[0] - a[0] for a, b in zip(lines, lines[1:]) if b[0] > a[0]]
    typical = median(gaps) if gaps else 0.0
    left = median([min(w["x0"] for w in ws) for _, ws, _ in lines]) if lines else 0.0
    least = 0
    for i, (y, ws, text) in enumerate(lines):
        heights = [w["y1"] - w["y0"] for w in ws if w["y1"] > w["y0"]]
        unit = max(0.008, (median(heights) if heights else 0.012) * 0.65)
        edges = (min(w["x0"] for w in ws), min(w["y0"] for w in ws), max(w["x1"] for w in ws), max(w["y1"] for w in ws))
        offset = edges[0] - left
        indent = 0 if offset < unit * 0.55 else max(1, min(6, round(offset / unit)))
        apart = i > 0 and typical > 0 and y - lines[i - 1][0] >= max(0.018, 1.6 * typical)
        least = max(least, printed_line(anchors, y))
        on = len(anchors) >= 2 and any(abs(y - a) <= W.ROW_TOLERANCE for a, _ in anchors)
        x0, y0, x1, y1 = (float(min(max(v, 0.0), 1.0)) for v in edges)
        sure = [w["confidence"] for w in ws if w["confidence"] is not None]
        out.append((side, len(out), least, {"x0": x0, "y0": y0, "x1": x1 if x1 > x0 else min(1.0, x0 + 1e-4), "y1": y1 if y1 > y0 else min(1.0, y0 + 1e-4)}, text, mean(sure) if sure else None,
                    "detected" if on else "interpolated", "high" if on else "medium", bool(indent > 0 or apart), indent))


def join_words(texts: list[str], x0: np.ndarray, x1: np.ndarray, tabs: bool) -> str:
    """Words of a line in order; with tabs, gaps of about three characters are one to four of them."""
    widths = [(b - a) / len(t.strip()) for t, a, b in zip(texts, x0, x1) if b > a and t.strip()]
    char = float(np.median(widths)) if widths else 0.0
    out = texts[:1]
    for i in range(1, len(texts)):
        gap = max(0.0, x0[i] - x1[i - 1])
        wide = tabs and char > 0 and gap >= max(0.012, 2.75 * char)
        out += ["\t" * max(1, min(4, round(gap / max(4 * char, 0.018)))) if wide else " ", texts[i]]
    return "".join(out).strip()


def tables(pages):
    kinds = {"own": pa.int32(), "marks": pa.list_(pa.struct([("cy", pa.float64()), ("n", pa.int32())])), "text": pa.string(), "_page": pa.bool_(), **{c: pa.int32() for c in W.PAGE}}
    rows = [r for i, words in enumerate(pages) for r in ({**{c: words[0][c] for c in W.INFO}, "doc_id": 1, "page_index": i, "_page": True}, *({**{c: w[c] for c in W.WORD}, "doc_id": 1, "page_index": i} for w in words))]
    names = [*W.PAGE, *W.WORD, *W.INFO, "_page"]
    return pa.table([pa.array([r.get(c) for r in rows], kinds.get(c, pa.float64())) for c in names], names)


def odd_page(rng):
    number = rng.choice([0, 2, 3, 6])
    marks = sorted((round(rng.uniform(0.07, 0.9), 3), rng.choice([5, 10, 15, 20, 25, 30])) for _ in range(number)) if rng.random() < 0.5 else [(0.2 + 0.1 * i, 5 * i + 5) for i in range(number)]
    strip = {"gutter_x": 0.5, "lo": 0.486, "hi": 0.514} if marks else {"gutter_x": None, "lo": None, "hi": None}
    first = {"own": rng.choice([None, 3]), "header_y": rng.choice([0.06, 0.0535]), "marks": [{"cy": y, "n": n} for y, n in marks] or None, **strip}
    rows = [rng.uniform(0.05, 0.97) for _ in range(rng.randint(1, 12))]
    words = []
    for _ in range(rng.randint(1, 60)):
        x, y, h = rng.choice([rng.uniform(0.0, 0.95), 0.1, 0.48, 0.55]), rng.choice(rows) + rng.choice([0.0, 0.002, 0.006]), rng.choice([0.0, 0.008, 0.012])
        text = rng.choice(["the", "a", "12", "123.", "1234", "x1", "", " ", "²", "é ", "housing"])
        words.append({"text": text, "x0": x, "y0": rng.choice([y] * 20 + [None]), "x1": x + rng.choice([0.0, 0.03, 0.1]), "y1": y + h, "confidence": rng.choice([None, 90.0, 55.5]), **first})
    return words


@pytest.mark.parametrize("method", ["native", "ocr"])
def test_pages_together_are_the_pages_alone(method):
    rng = random.Random(3)
    pages = [odd_page(rng) for _ in range(400)]
    want = [(i, p[0]["own"], *r) for i, p in enumerate(pages) for r in read_page(p, method)]
    got = [tuple(r.values())[1:] for r in W._read_pages(tables(pages), method).to_pylist()]
    assert len(got) == len(want) > 1000
    near = lambda v: round(v, 9) if isinstance(v, float) else {k: round(x, 9) for k, x in v.items()} if isinstance(v, dict) else v
    assert [tuple(map(near, r)) for r in got] == [tuple(map(near, r)) for r in want]


def test_pages_are_whole_however_rows_come():
    rng = random.Random(4)
    table = tables([odd_page(rng) for _ in range(30)])
    whole = W._read_pages(table, "native").to_pylist()
    for size in (1, 7, 50, 10_000):
        parts = list(W._whole_pages(iter(table.to_batches(max_chunksize=size))))
        assert [r for t in parts for r in W._read_pages(t, "native").to_pylist()] == whole
    assert list(W._whole_pages(iter([]))) == []


def test_running_headers_of_pages_with_a_country_code(spark):
    """The lowest row with a code and an identifier; pages without a code are not grouped into lines."""
    word = lambda page, ix, text, y: ("d", page, ix, text, 0.1 * ix, y, 0.1 * ix + 0.05, y + 0.01, None)
    rows = [word(0, 1, "US", 0.02), word(0, 2, "1,234", 0.02), word(0, 3, "us9", 0.06), word(0, 4, "US", 0.1), word(0, 5, "x", 0.1), word(1, 1, "12", 0.02), word(1, 2, "B2", 0.02), word(2, 1, "US", 0.2), word(2, 2, "12", 0.2)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, word_ix int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    found = W.running_header(df)
    assert [(r["page_index"], round(r["running_y"], 9)) for r in found.collect()] == [(0, 0.065)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
