"""Packing, resampling and vector codes against plain versions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, resampling, vector_codes

from .conftest import as_rows
from .test_per_document import fuzz

JSON, OTHER = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def test_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    for path in (JSON, OTHER):
        ref, own = Tokenizer.from_file(path), packing.Encoder(path)
        for t in [*fuzz(), "no end" * 40 + " a<|endoftext|> b  c\n\n d" * 20, "<|endoftext|>"]:
            assert own.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids, t


def test_fill_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(300):
        left = {rnd.randint(1, 12): rnd.randint(1, 4) for _ in range(rnd.randint(0, 5))}
        capacity = rnd.randint(0, 30)
        sums = {sum(x * n for x, n in zip(left, take)) for take in itertools.product(*(range(n + 1) for n in left.values()))}
        got = packing.fill(left, capacity)
        assert all(0 < n <= left[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= capacity)


@pytest.mark.parametrize("seed", range(40))
def test_every_rest_has_its_place(seed):
    rnd, window = random.Random(seed), 64
    counts = {rnd.randint(1, 63): rnd.choice([1, 3, 40, 1000]) for _ in range(rnd.choice([1, 2, 10, 40]))}
    plan = packing.Plan(counts, window, 5)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    parts = list(packing.places(plan.table(), length, rank))
    which, start, taken, sequence, offset = (np.concatenate(x) for x in zip(*parts))
    by_rest, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for w, s, t, q, o in zip(which, start, taken, sequence, offset):
        by_rest[w].append((s, s + t))
        by_sequence[q].append((o, o + t))
    whole = lambda spans: sorted(spans)[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(sorted(spans)))
    assert len(by_rest) == len(length) and all(whole(x) and max(x)[1] == length[w] for w, x in by_rest.items())
    assert all(map(whole, by_sequence.values())) and sorted(by_sequence) == list(range(5, plan.next))
    sizes = [max(x)[1] for x in by_sequence.values()]
    assert all(n == window or n & (n - 1) == 0 for n in sizes) and sum(n < window for n in sizes) <= 6
    assert plan.next - 5 <= -(-int(length.sum()) // window) + 6


def check_packed(rows, pieces, window, end_id):
    ref = Tokenizer.from_file(JSON)
    want = collections.Counter((i, tuple(ref.encode(t or "", add_special_tokens=False).ids + [end_id])) for i, t in rows)
    spans, ids = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
        ids[r["doc_id"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(x)) and x[-1][1] <= window
    assert sum(x[-1][1] & (x[-1][1] - 1) > 0 for x in spans.values()) == 0
    for doc in {i for i, _ in rows}:
        whole = [(d, n) for (i, d), n in want.items() if i == doc]
        got = collections.Counter(ids[doc])
        assert got == collections.Counter({p: m for p, m in got.items()})
        if len(whole) == 1 and whole[0][1] == 1:  # one document of that id: its pieces, put together
            assert sum((p[1] for p in sorted(ids[doc])), ()) == whole[0][0] and all(p[2] == len(whole[0][0]) for p in ids[doc])
        assert sum(len(p[1]) for p in ids[doc]) == sum(len(d) * n for d, n in whole)


def test_packing(spark, odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    got = packing.pack(odd, JSON, 64, 1).collect()
    check_packed([(r[0], r[1]) for r in odd_rows], got, 64, 1)
    assert packing.pack(empty, JSON, 64).count() == 0
    assert packing.pack(odd.where("text is null"), JSON, 64, None).count() == 0


def test_packing_of_one_hot_length(spark):
    rows = [(i, "word " * 40) for i in range(300)] + [(300 + i, "a b c") for i in range(20)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), JSON, 64, 1)
    check_packed(rows, pieces.collect(), 64, 1)
    whole = packing.sequences(pieces, 64, pad_id=9).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in pieces.collect())
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)  # powers of two are not padded
    some = spark.createDataFrame([(7, 0, bytearray(b"\1\0\0\0" * 3), 3)], "sequence_id long, offset long, ids binary, length long")
    assert packing.sequences(some, 8, pad_id=9).first()["ids"] == b"\1\0\0\0" * 3 + b"\x09\0\0\0" * 5


def plain_resample(rows, target, longest, buckets, percent, least, seed):
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]
        return len(ws), [zlib.crc32(x.encode()) % buckets for x in runs]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = (collections.Counter(b for x in xs for b in x) for xs in ([x for _, _, x in docs], [features(x)[1] for x in target]))
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in s}
    out = []
    for i, words, fs in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in fs)
        out.append([i, words, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, -x[2]))
    drawn = len(able) * percent // 100
    ranked = [(x[0], x[2], x[3], x[4], r if r <= drawn else None) for r, x in enumerate(able, 1)]
    return sorted(ranked + [(x[0], x[2], x[3], x[4], None) for x in out if x[1] < least], key=repr)


@pytest.mark.parametrize("longest, rows_a_block", [(1, 2000), (3, 4)])
def test_resampling(spark, odd, odd_rows, empty, longest, rows_a_block, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", rows_a_block)
    target = [(1, "The Housing of the motor, the PANEL"), (2, None), (3, "über-token é")]
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(odd, bench, longest, 50, 40, 5, 7)
    assert as_rows(got) == plain_resample([(r[0], r[1]) for r in odd_rows], [t for _, t in target], longest, 50, 40, 5, 7)
    assert resampling.resample(empty, bench).count() == 0
    none = resampling.resample(odd, bench.where("false"), longest, 50, 40, 5, 7)
    assert as_rows(none) == plain_resample([(r[0], r[1]) for r in odd_rows], [], longest, 50, 40, 5, 7)


def test_blocks_are_sparse_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string").coalesce(1)
    r = resampling.csr_blocks(df, 1, 1000).first()
    a, b = (zlib.crc32(x) % 1000 for x in (b"a", b"b"))
    assert r["doc_ids"] == [1, 2, 3] and r["indptr"] == [0, 2, 2, 3] and r["n_words"] == [3, 0, 1]
    assert dict(zip(r["indices"][:2], r["data"][:2])) == {a: 2, b: 1} and r["indices"][2] == b


def test_blocks_stay_small_in_large_files(spark, monkeypatch):
    """Rows and row groups of the written blocks do not grow with the file, as a reader holds up to 4,096 rows of a group."""
    wide, groups = [], []

    def seen(blocks):
        wide.append(blocks.select(F.max(F.size("indices"))).first()[0])
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
        groups.extend(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups))

    monkeypatch.setattr(resampling, "forget", seen)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id"), i), F.lit(20_000)))), " ")
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    assert resampling.resample(docs, spark.createDataFrame([("w1 w2",)], "text string")).where("n_features = 2000").count() == 2000
    assert wide[0] <= 40_000 and len(groups) > 1 and max(groups) < 16_000_000


def test_ranks_over_many_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("s")).repartition(6)
    got = {r["id"]: r["rank"] for r in resampling.ranked(df, [F.desc("s"), F.asc("id")]).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}


@pytest.mark.parametrize("seed", range(8))
def test_nearest_with_ties(seed):
    rnd = np.random.default_rng(seed)
    book = rnd.integers(-3, 4, (rnd.integers(1, 200), 3))  # small integers: many ties and equal entries
    points = rnd.integers(-5, 6, (500, 3))
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    index, best = vector_codes.KdTree(book).nearest(points)
    assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for *_, v in kept)
    width = -(-width // parts) * parts
    kept = [(i, lab, v + [0] * (width - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    step = width // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for *_, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for c in cut:
                got[near(c[p], books[p])[1]].append(c[p])
            for k, xs in got.items():
                books[p][k] = [sum(x) // len(xs) for x in zip(*xs)]
    out = []
    for (i, lab, _), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sums = collections.Counter()
    for _, lab, _, d in out:
        sums[lab] += d
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, c, d, sums[lab]) for i, lab, c, d in out), key=repr), digest


VECTORS = "vec_id long, embedding array<float>, label string, id long, code string, _label string"


def test_vector_codes(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, -0.125, 0.0, 0.25, 1.0]) for _ in range(7)], rnd.choice("ab")) for i in range(60)]
    rows += [(3, rows[5][1], None), (3, rows[3][1], "a"), (None, rows[1][1], None), (99, None, "a"), (98, [None] * 7, "b"), (97, [math.nan] * 7, "b"), (96, [math.inf] * 7, "a"), (95, [1.0, 2.0], "b"), (94, [], "b")]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], VECTORS).repartition(4)
    for entries in (5, 200):
        want, digest = plain_codes(rows, 4, entries, 3, 10)
        got = vector_codes.compress(df, 4, entries, 3, 10)
        assert as_rows(vector_codes.with_label_errors(got.rows).select("vec_id", "label", "code", "error", "label_error")) == want
        assert got.digest() == digest
    none = vector_codes.compress(df.where("false"))
    assert none.rows.count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e9], "a", 0, "", "")], VECTORS))
