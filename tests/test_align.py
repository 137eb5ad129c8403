"""Alignment against a scan of all windows, and of whole tables against one cursor."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from functools import partial

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import align as A
from tessera.plans import documents


def scan(self, at, line, reach, back, hopeless=0.0):
    """Every window in turn; the first of the best."""
    n, best = len(line), (0.0, at, at)
    for start in range(max(0, at - back), min(len(self.forms), at + n + reach)):
        for end in (start + n - 1, start + n, start + n + 1):
            if start < end <= len(self.forms):
                r = SequenceMatcher(None, " ".join(line), " ".join(self.forms[start:end])).ratio()
                if r > best[0]:
                    best = (r, start, end)
    return best


def damaged(rnd, line):
    """A line as badly read: letters lost and changed, a word cut, lost or doubled."""
    out = "".join(rnd.choice(["", "c", "1", x]) if rnd.random() < 0.06 else x for x in line).split()
    if out and rnd.random() < 0.2:
        out.pop(rnd.randrange(len(out)))
    if out and rnd.random() < 0.2:
        out.insert(0, out[0][2:])
    return " ".join(out)


def passage(rnd, n, vocabulary=400):
    words = ["w" + "".join(rnd.choices("aeiostn", k=rnd.randint(1, 8))) for _ in range(vocabulary)]
    return [rnd.choice(words) + rnd.choice(["", "", "", ",", ".", "/it", " -"]) for _ in range(n)]


def lines_of(words, rnd):
    at, out = 0, []
    while at < len(words):
        n = rnd.randint(1, 12)
        out.append(" ".join(words[at : at + n]))
        at += n
    return out


@pytest.mark.parametrize("seed", range(12))
def test_bounds_lose_no_window(seed):
    rnd = random.Random(seed)
    words = passage(rnd, 120, 25)
    clean = A.Clean(A.tokens("\n".join(lines_of(words, rnd))))
    for _ in range(25):
        at = rnd.randrange(len(clean.forms) + 3)
        n = rnd.randint(1, 9)
        line = [p for w in damaged(rnd, " ".join(words[at : at + n]) or "x").split() if (p := A.plain(w))] or ["x"]
        for reach, back in ((8, 2), (60, 0)):
            assert clean.likest(at, line, reach, back) == scan(clean, at, line, reach, back)
            hard = clean.likest(at, line, reach, back, 0.88)
            assert hard == scan(clean, at, line, reach, back) or hard[0] < 0.88
    assert A.Clean([]).likest(0, ["a"], 8, 2) == (0.0, 0, 0)


def plainly_aligned(read, text, flow):
    """One cursor over the whole document, but lines of the heaviest chain of those that stand at one place only are taken as they stand."""
    clean = A.Clean(A.tokens(text))
    runs = lambda ws: [tuple(ws[i : i + A.SEED]) for i in range(len(ws) - A.SEED + 1)]
    there = runs(clean.forms)
    found = []
    for i, line in enumerate(read):
        own = runs([p for w in line.split() if (p := A.plain(w))])
        at = [k for k in range(len(there)) if own and there[k : k + len(own)] == own]
        if at and all(there.count(r) == 1 for r in own):
            found.append((i, at[0], len(own) + A.SEED - 1))
    best = []
    for k, (_, start, n) in enumerate(found):
        ahead = max(((w, -j) for j, (w, _) in enumerate(best) if found[j][1] + found[j][2] <= start), default=(0, 1))
        best.append((ahead[0] + n, -ahead[1]))
    k = max(range(len(best)), key=lambda k: (best[k][0], -k), default=-1)
    chain = {}
    while k >= 0:
        chain[found[k][0]] = found[k][1:]
        k = best[k][1]
    out, at = [], 0
    for i, line in enumerate(read):
        if i in chain:
            start, n = chain[i]
            at = start + n
            out.append((" ".join(w for w, _, _ in clean.words[start:at]), "exact", 1.0, clean.words[start][2]))
            continue
        got = A.followed([line], clean, A.Settings(), [flow[i]], at, out[-1][0] if out else None)[0]
        if got[3] is not None:
            near = [k for k in range(max(0, at - 2), len(clean.words)) if any(" ".join(w for w, _, _ in clean.words[k : k + m]) == got[0] and clean.words[k][2] == got[3] for m in range(1, 16))]
            at = near[0] + len(got[0].split())
        out.append(got)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tables_follow_the_cursor(spark, seed, monkeypatch):
    """Chained lines, and what lies between them, come out as one cursor over the whole document has them."""
    rnd = random.Random(seed)
    docs, entries, want, other = [], [], {}, 0
    for d, size in enumerate([0, 30, 400, 30, 500, 400]):
        said = lines_of(passage(rnd, size), rnd)
        text = "\n".join(said)
        read = [x if rnd.random() < 0.6 else damaged(rnd, x) for x in said]
        if len(read) > 20:
            del read[9]
            read.insert(14, "something else that stands nowhere")
        flow = [rnd.random() < 0.8 for _ in read]
        docs.append((d, text))
        entries += [(d, i, x, f) for i, (x, f) in enumerate(zip(read, flow))]
        with monkeypatch.context() as m:
            m.setattr(A.Clean, "likest", scan)
            got = plainly_aligned(read, text, flow)
            other += sum(a != b for a, b in zip(got, A.align(read, text, flow=flow)))
        last = 0
        for i, x in enumerate(got):
            want[d, i] = (*x, x[3] is not None and x[3] != last)
            last = x[3] if x[3] is not None else last
    e = spark.createDataFrame(entries + [(77, 0, "no clean text", True), (77, 1, None, True), (None, 0, "no id", None)], "doc_id int, ordinal int, source_text string, flow boolean").repartition(3)
    got = {(r["doc_id"], r["ordinal"]): tuple(r)[2:] for r in A.aligned(e, spark.createDataFrame(docs + [(78, None)], "doc_id int, clean_text string")).collect()}
    assert {k: v for k, v in got.items() if k[0] is not None and k[0] < 77} == want
    assert got[77, 0] == ("no clean text", "none", 0.0, None, False) and got[77, 1][0] == "" and got[None, 0][1] == "none"
    assert sum(v[1] == "exact" for v in want.values()) > 20 and any(v[1] == "fuzzy" for v in want.values())
    assert other <= len(want) // 50  # a cursor alone strays now and then


def test_chain_is_the_heaviest():
    rnd = random.Random(5)
    for _ in range(200):
        rows = [(i, rnd.randint(0, 15), rnd.randint(1, 4)) for i in range(rnd.randint(0, 8))]
        best = 0
        for mask in range(1 << len(rows)):
            some = [r for k, r in enumerate(rows) if mask >> k & 1]
            if all(a[1] + a[2] <= b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(r[2] for r in some))
        got = A._chained(pd.DataFrame(rows, columns=["ordinal", "start", "n"]))
        kept = list(got.itertuples(index=False))
        assert all(a.ordinal < b.ordinal and a.start + a.n <= b.start for a, b in zip(kept, kept[1:]))
        assert sum(r.n for r in kept) == best


def test_a_jump_and_a_repeat():
    clean = "the housing is mounted on the frame of the device\nand carries " + " ".join(f"w{i}" for i in range(120)) + "\na panel that is fixed to the housing"
    got = A.align(["the housing is mounted on the", "a panel that is fixed to the housing", "zzz qq"], clean)
    assert [(x[1], x[3]) for x in got] == [("exact", 0), ("exact", 2), ("unmatched", None)]
    assert got[2][0] == "zzz qq"
    follow = partial(A.is_clipped, "interface")
    assert [follow(w, True) for w in ("ace", "iterface", "interface", "xyz")] == [True, True, True, False]
    assert [follow(w) for w in ("nterface", "terface", "face", "interface")] == [True, True, False, False]


def test_wrapped_lines(spark):
    rows = [("aa bb cc dd", ["aa bb", "cc dd"]), ("abcdefghij kl", ["abcdefghij", "kl"]), ("", []), (None, None), ("a\nb  c", ["a\nb", "c"])]
    for text, want in rows:
        got = spark.createDataFrame([(text,)], "t string").select(T.wrapped(F.col("t"), 5).alias("x")).first()["x"]
        assert (got and [x.strip() for x in got]) == want, text


def test_all_character_references(spark):
    got = spark.createDataFrame([("<p>&frac12;&nbsp;&eacute; &#8211;&#x41; &amp;lt; a &unknown; b</p>",), ("plain",), (None,)], "h string").select(T.stripped_html(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in got] == ["½ é –A &lt; a &unknown; b", "plain", None]


def test_printed_lines_of_conversations(spark, tmp_path):
    said = [" ".join(f"word{t}x{i}" for i in range(20)) + (" better here" if t % 2 else "") for t in range(14)]
    spark.createDataFrame([(1, t, x) for t, x in enumerate(said)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = documents.align_lines(spark, str(tmp_path)).orderBy("turn", "line").collect()
    lines = [x for t, text in enumerate(said) for x in [ln.replace("e", "c") if t % 2 else ln for ln in spark.createDataFrame([(text,)], "t string").select(T.wrapped(F.col("t"), 60).alias("x")).first()["x"]]]
    want = A.align(lines, "\n".join(said))
    assert [(r["alignment_method"], r["alignment_score"]) for r in got] == [x[1:3] for x in want]


def test_likeness_is_that_of_the_sequence_matcher():
    rnd = random.Random(5)
    for _ in range(3_000):
        letters, most = rnd.choice(["ab", "abc ", "etaoin shrdlu"]), rnd.choice([4, 40, 90, 230])
        a = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
        b = "".join(c for c in a.replace("e", "c") if rnd.random() < 0.9) if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
        assert A.likeness(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_words_given_as_lines_make_the_same_clean_text():
    words = A.tokens("One two-three,\nfour's 5")
    one, two = A.Clean(words), A.Clean.of(*("\n".join(x[i] for x in words) for i in (0, 1)), [x[2] for x in words])
    assert one.words == two.words == words
    assert (one.before == two.before).all() and one.before[-1].sum() == sum(map(len, one.forms))
    assert A.Clean.of(None, None, []).words == []
