"""Operators that look at one document at a time, against the libraries or a plain version."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, language_id, licenses, token_counts, toxicity

from .conftest import as_rows

BPE, JSON, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def fuzz():
    rnd = random.Random(1)
    odd = [chr(i) for i in range(0x250)] + list("́ᅡ​ 　﻿Kς한字😀½²")
    return ["".join(rnd.choices(odd, k=rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, " " * 3000 + "x", "", "a<|endoftext|>b", "<|EndOfText|>", "don't WE'LL 's"]


def test_bpe_is_tiktoken():
    own = byte_bpe.ByteBpe(BPE, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})
    for t in fuzz():
        ids = own.encode(t)
        assert memoryview(ids).cast("I").tolist() == ref.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_bpe_cache_limit(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    own = byte_bpe.ByteBpe(BPE, P.PATTERN)
    for t in ("one two three four five", "six seven one", "one two"):
        assert own.decode(own.encode(t)).decode() == t


def test_bpe_rows(odd, odd_rows, empty):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})
    want = []
    for i, t, *_ in odd_rows:
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = byte_bpe.encode_decode(odd, BPE, P.PATTERN)
    assert as_rows(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")) == sorted(want, key=repr)
    assert byte_bpe.encode_decode(empty, BPE, P.PATTERN).count() == 0


def test_model_needs_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


def test_token_counts(odd, odd_rows, empty):
    ref = Tokenizer.from_file(JSON)
    own = token_counts.Counter(JSON)
    for t in fuzz():
        assert own.count(t) == len(ref.encode(t, add_special_tokens=False)), t
    want = sorted(((i, len((t or "").encode()), n := len(ref.encode(t or "", add_special_tokens=False)), n > 2048) for i, t, *_ in odd_rows), key=repr)
    assert as_rows(token_counts.token_counts(odd, JSON)) == want
    assert token_counts.token_counts(empty, JSON).count() == 0


def test_whole_tokens_need_no_merging(monkeypatch):
    ref, own, merged = Tokenizer.from_file(JSON), token_counts.Counter(JSON), []
    one = own._merged
    monkeypatch.setattr(own, "_merged", lambda w: merged.append(w) or one(w))
    for t in ["the people of this city", "the people of “this” city — 漢字", "naïve the 😀"]:
        assert own.count(t) == len(ref.encode(t, add_special_tokens=False)), t
    assert not {"the", "people", "of", "this", "city"} & set(merged)


def test_long_words_are_summed_in_blocks(monkeypatch):
    import numpy as np

    rnd, vocab = random.Random(6), {p: i for i, p in enumerate(["▁", "a", "b", "ab", "bab", "abba", "▁a"])}
    probs = np.array([[0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.0], [0.2, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.0]])
    words = ["▁" + "".join(rnd.choices("abc", k=60)) for _ in range(5)]
    whole = np.log(language_id.forward(language_id.lattice(words, vocab), probs)[:, :, -1])
    for block in (1024, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert np.allclose(language_id.log_forward(words, vocab, probs), whole, rtol=1e-12)
    assert np.isfinite(language_id.log_forward(["▁" + "ab" * 3000], vocab, probs)).all()


def test_forward_sums_all_segmentations():
    import numpy as np

    vocab = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    probs = np.array([[0.1, 0.2, 0.3, 0.15, 0.25, 0.0, 0.0]])
    got = language_id.forward(language_id.lattice(["▁ab"], vocab), probs)[0, 0, 3]
    assert abs(got - (0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.25 * 0.3)) < 1e-15


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, PIECES, ~language_id.held_out(), per_language=100)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out())
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    short = spark.createDataFrame([(1, None), (2, "123 !!"), (3, ""), (4, "½ ² ٣")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(short, model).collect()] == ["und"] * 4
    none = language_id.fit(empty, PIECES, ~language_id.held_out())
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_languages_are_learned_from_the_allowed_rows_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language_id.fit(d, PIECES, ~language_id.held_out(), per_language=20) for d in (docs, other))
    assert a.languages == b.languages and (a.probs == b.probs).all()


def test_toxicity(spark, odd, empty):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("the of and motor frame panel".split(), k=12) + (["idiot", "scum"] if i % 4 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs.where("doc_id < 300"), labels)
    got = toxicity.score(docs.where("doc_id >= 300"), chain).collect()
    assert all(r["is_toxic"] == (r["doc_id"] % 4 == 0) for r in got)
    scored = toxicity.score(odd, chain, keep=["text", "label"])
    assert scored.count() == odd.count()
    assert not any(r["is_toxic"] for r in scored.where("text is null or trim(text) = ''").collect())
    assert toxicity.score(empty, chain).count() == 0
    nothing = toxicity.fit(empty, labels)
    assert not any(r["is_toxic"] for r in toxicity.score(odd, nothing).collect())


def test_chain_scores_like_a_plain_sum(spark, odd, odd_rows):
    """The query's scoring against the sum of weights over a text's distinct features, link by link."""
    import math
    import re

    docs = spark.createDataFrame([(i, ("idiot scum " if i % 3 == 0 else "") + "the motor frame " + "panel of device " * (i % 5)) for i in range(150)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), int(i % 3 < 2)) for i in range(150)], "doc_id long, quality int, toxic int, insult int")
    chain = toxicity.fit(docs, labels, ("quality", "toxic", "insult"))

    def plain(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        seen = {f for w in words for f in toxicity.features(w)}
        p = []
        for m in chain.models:
            weight = dict(zip(m.buckets.tolist(), m.weights.tolist()))
            x = sum(weight.get(f, 0) for f in seen) + m.base[0] + sum(a * b for a, b in zip(p, m.base[1:]))
            p.append(1 / (1 + math.exp(-max(-30, min(30, x)))))
        return [round(x, 9) for x in p], [x > m.cut and bool(words) for x, m in zip(p, chain.models)]

    got = as_rows(toxicity.score(odd, chain))
    want = sorted(((i, *plain(t)[0], *plain(t)[1]) for i, t, *_ in odd_rows), key=repr)
    rounded = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got]
    key = lambda r: (repr(r[0]), r[1:])
    for a, b in zip(sorted(rounded, key=key), sorted(want, key=key)):
        assert a[0] == b[0] and a[4:] == b[4:] and all(abs(x - y) < 1e-8 for x, y in zip(a[1:4], b[1:4]))


def test_language_scores_like_a_plain_sum(spark, odd, odd_rows):
    """Texts' predictions against a forward pass that is written out character by character."""
    import math
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, PIECES, ~language_id.held_out(), per_language=20)
    vocab = language_id.vocabulary(PIECES)

    def chance(word, probs):
        alpha = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            for k in range(1, e + 1):
                at = vocab.get(word[e - k : e], len(vocab) if k == 1 else None)
                alpha[e] += alpha[e - k] * probs[at] if at is not None else 0
        return alpha[-1]

    def plain(text):
        words = language_id._words(text.lower()) if text else []
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        logs = [sum(math.log(max(chance(s, p), 1e-300)) for s in (language_id.START + w for w in words)) for p in model.probs]
        best = max(range(len(logs)), key=lambda i: logs[i])
        return model.languages[best], 1 / sum(math.exp(x - logs[best]) for x in logs)

    long_word = spark.createDataFrame([(900, "die donaudampfschifffahrtsgesellschaftskapitän " * 3 + "x" * 80)], "doc_id long, text string")
    short = odd.where("text is null or length(text) < 400").select("doc_id", "text").union(long_word)
    got = {(r["doc_id"], i): r for i, r in enumerate(language_id.identify(short.select("doc_id", "text").orderBy("doc_id", "text").coalesce(1), model).collect())}
    texts = [r["text"] for r in short.select("doc_id", "text").orderBy("doc_id", "text").coalesce(1).collect()]
    for (_, r), t in zip(got.items(), texts):
        lang, score = plain(t)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def test_later_models_see_out_of_fold_probabilities():
    import numpy as np

    y = np.array([0, 1] * 60)
    at, owner = np.concatenate([y + 1, np.full(120, 9)]).astype(np.int32), np.concatenate([np.arange(120), np.arange(120)]).astype(np.int32)
    models = toxicity.fit_chain(at, owner, np.stack([y, y], axis=1), np.arange(120) % 3)
    assert len(models[1].base) == 2 and models[1].base[1] > 0


MIT = (licenses.TEXTS / "MIT.txt").read_text()


def test_whole_licence_texts_are_found(spark):
    """Each known text, with other case, punctuation, line breaks and a copyright line, and the texts that a system has."""
    from pathlib import Path

    known = [(i, t) for i, t in licenses.known_texts() if "\n" in t]
    assert len({i for i, _ in known}) >= 20
    rows = [(f"{n} {i}", "Copyright 2021 Ann and others.\n" + t.upper().replace(",", " ;").replace("\n", "\n\n  ")) for n, (i, t) in enumerate(known)]
    here = Path("/usr/share/common-licenses")
    rows += [(f"x {i}", (here / f).read_text()) for f, i in [("GPL-3", "GPL-3.0"), ("Apache-2.0", "Apache-2.0")] if (here / f).exists()]
    got = licenses.scan(spark.createDataFrame(rows + [("none", MIT + " and more")], "doc_id string, text string"), licenses.known_digests(spark))
    assert {r["doc_id"]: r["text_license"] for r in got.collect()} == {**{k: k.split(" ")[1] for k, _ in rows}, "none": None}


def test_licenses(spark, odd, empty):
    rows = [(1, MIT.upper().replace(",", ";")), (2, "Copyright (c) 2020 Ann\n" + MIT), (3, "text\nReleased under the MIT Licence!\nreleased under the mit license"), (4, None), (5, "nothing"), (3, "text\nReleased under the MIT Licence!\nreleased under the mit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark))
    assert sorted((r["doc_id"], r["text_license"], r["n_notices"], r["licenses"]) for r in got.collect() if r["doc_id"] != 4 and r["doc_id"] != 5) == [(1, "MIT", 0, "MIT"), (2, "MIT", 0, "MIT"), (3, None, 2, "MIT"), (3, None, 2, "MIT")]
    assert licenses.scan(odd, licenses.known_digests(spark)).count() == odd.count()
    assert licenses.scan(empty, licenses.known_digests(spark)).count() == 0
    assert licenses.scan(odd, licenses.known_digests(spark, [])).where("licenses <> ''").count() == 0
