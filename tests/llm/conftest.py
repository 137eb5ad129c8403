from __future__ import annotations

import random

import pytest

#: A table that has all the odd cases, and columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a long, b long, label string, digest string, spans string, w string"


@pytest.fixture(scope="session")
def odd_rows():
    rnd = random.Random(7)
    words = "the of and device housing frame panel motor signal é über 😀 token idiot".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randint(3, 60))) for _ in range(40)]
    texts += [texts[0], texts[1] + " extra", texts[2], None, "", "   \n\t", "x", "a b", "1234 !!", "ab " * 30_000, texts[3].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (6, "another text of six"), (None, texts[7]), (None, None), (None, "only here")]
    return [(i, t, rnd.choice(["en", "fr", None]), f"s{rnd.randint(0, 3)}", len(t or ""), 1, 2, 3, "l", "d", "s", "w") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
