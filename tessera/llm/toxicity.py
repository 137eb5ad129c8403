"""Toxicity by a classifier chain of linear models.

The categories are predicted in a fixed order. Each model is a logistic
regression over hashed words and word beginnings, and takes the
probabilities of the earlier categories as further inputs. While
training, those are out-of-fold predictions: a row's earlier probability comes
from a model that has not seen the row, as it will be for new documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import lean_batches, texts

#: Hash buckets of features.
BUCKETS = 1 << 20
#: Labelled rows that the chain is fitted on at most (a hash of the id picks them); the bound of what the driver holds.
MAX_ROWS = 6_000
#: Features a model keeps, and the least z-score for it.
MAX_FEATURES, LEAST_Z = 4096, 3.0
#: Rows that a feature must be in.
LEAST_ROWS = 3
FOLDS = 3
#: Feature entries that the driver works on at once.
STRETCH = 500_000
#: Words that a worker remembers; beyond it starts anew.
CACHE = 150_000

_words = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word: itself and its first 5 to 7 letters."""
    parts = [f"w{word}", *(f"{n}{word[:n]}" for n in (5, 6, 7) if len(word) >= n)]
    return tuple({zlib.crc32(p.encode()) % BUCKETS for p in parts})


def rows_of(words: set[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The buckets that a document has, each once."""
    out: set[int] = set()
    for w in words:
        f = cache.get(w)
        if f is None:
            if len(cache) > CACHE:
                cache.clear()
            f = cache[w] = features(w)
        out.update(f)
    return np.fromiter(out, np.int32, len(out))


@dataclass
class Linear:
    """buckets and their weights; base holds the intercept and a weight for each earlier category."""

    buckets: np.ndarray
    weights: np.ndarray
    base: np.ndarray
    cut: float

    def margin(self, text_part: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return text_part + self.base[0] + earlier @ self.base[1:]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(n: int, where, weight) -> np.ndarray:
    """Sums of weight(i, j) by where(i, j), taken in stretches i to j, which keeps temporary arrays small."""
    out, i = np.zeros(n), 0
    while len(at := where(i, i + STRETCH)):
        w = weight(i, i + STRETCH)
        out += np.bincount(at, w, n)
        i += STRETCH
    return out


def _choose(at: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets whose document frequency differs most between the classes, by a two-proportion z-score."""
    pos = _sums(BUCKETS, lambda i, j: at[i:j], lambda i, j: y[owner[i:j]])
    both = _sums(BUCKETS, lambda i, j: at[i:j], lambda i, j: None)
    n1, n = max(y.sum(), 1), max(len(y), 2)
    n0 = max(n - n1, 1)
    mean = (both + 1) / (n + 2)
    z = (pos / n1 - (both - pos) / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    z[both < LEAST_ROWS] = 0
    top = np.argsort(-np.abs(z), kind="stable")[:MAX_FEATURES]
    return np.sort(top[np.abs(z[top]) >= LEAST_Z])


def _fit(at: np.ndarray, owner: np.ndarray, y: np.ndarray, earlier: np.ndarray, rounds: int = 150) -> Linear:
    """Logistic regression by full-batch Adagrad with an L2 penalty."""
    n = len(y)
    buckets = _choose(at, owner, y)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[buckets] = np.arange(len(buckets), dtype=np.int32)
    use = slot[at] >= 0
    f, o = slot[at[use]], owner[use]
    x = np.hstack([np.ones((n, 1)), earlier])
    pos, both = np.bincount(f, y[o], len(buckets)), np.bincount(f, minlength=len(buckets))
    w, b = 0.5 * np.log((pos + 0.5) / (both - pos + 0.5)), np.zeros(x.shape[1])  # starts at half the log odds of each feature
    b[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    w -= 0.5 * b[0]
    sw, sb = np.full(len(w), 1e-6), np.full(len(b), 1e-6)
    for _ in range(rounds):
        err = _sigmoid(np.bincount(o, w[f], n) + x @ b) - y
        gw, gb = np.bincount(f, err[o], len(w)) + 0.3 * w, x.T @ err
        sw += gw**2
        sb += gb**2
        w -= 0.3 * gw / np.sqrt(sw)
        b -= 0.3 * gb / np.sqrt(sb)
    return Linear(buckets, w, b, 0.5)


def _text_part(m: Linear, at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    w = np.zeros(BUCKETS)
    w[m.buckets] = m.weights
    return _sums(n, lambda i, j: owner[i:j], lambda i, j: w[at[i:j]])


def fit_chain(at: np.ndarray, owner: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """labels: one column a category, in the chain's order; fold: of each row."""
    n, models = len(labels), []
    earlier = np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        oof = np.zeros(n)
        for k in range(FOLDS):
            out = fold == k
            if not out.any() or out.all():
                continue
            back = (np.cumsum(~out) - 1).astype(np.int32)
            use = ~out[owner]
            m = _fit(at[use], back[owner[use]], y[~out], earlier[~out])
            oof[out] = _sigmoid(m.margin(_text_part(m, at[~use], owner[~use], n)[out], earlier[out]))
        m = _fit(at, owner, y, earlier)
        m.cut = _cut(oof, y)
        models.append(m)
        earlier = np.hstack([earlier, oof[:, None]])
    return models


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which the out-of-fold F1 is best."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    i = int(np.argmax(f1))
    lower = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float(np.clip((p[order[i]] + lower) / 2, 0.05, 0.95))


class Chain:
    """Fitted models; score() gives each category's probability of a text."""

    def __init__(self, categories: Sequence[str], models: list[Linear]):
        self.categories, self.models = list(categories), models

    def slots(self):
        """bucket -> weights of all categories, for the buckets that have any."""
        out: dict[int, np.ndarray] = {}
        for i, m in enumerate(self.models):
            for b, w in zip(m.buckets.tolist(), m.weights.tolist()):
                out.setdefault(b, np.zeros(len(self.models)))[i] = w
        return out

    def probabilities(self, part: np.ndarray) -> np.ndarray:
        """part: summed text weights, a row a document."""
        p = np.zeros((len(part), 0))
        for i, m in enumerate(self.models):
            p = np.hstack([p, _sigmoid(m.margin(part[:, i], p))[:, None]])
        return p


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    """Fit on at most about max_rows labelled rows, picked by a hash of the id.

    A row with a null id or a null category is not used; where an id has
    several labels, each category takes the largest; where it has several
    texts, each is a row. Without any labelled row the chain rates all texts 0.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    share = min(1.0, max_rows / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("pick")), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    rows = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")  # its size has a bound: max_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            got = [rows_of(set(_words(t.as_py().lower())), cache).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["fold", "y", "at"])

    n_cat = len(categories)
    sent = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), F.array(*[F.col(f"y{i}") for i in range(n_cat)]).alias("y"), "text").mapInArrow(run, "fold int, y array<double>, at binary")
    got = sent.collect()
    if not got:
        none = Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(1), 0.5)
        return Chain(categories, [Linear(none.buckets, none.weights, np.concatenate([[-30.0], np.zeros(i)]), 0.5) for i in range(n_cat)])
    y, fold = np.array([r["y"] for r in got]), np.array([r["fold"] for r in got])
    parts = [np.frombuffer(r["at"], np.int32) for r in got]
    del got
    rare = sum((np.bincount(x, minlength=BUCKETS) for x in (np.concatenate(parts[i : i + 500]) for i in range(0, len(parts), 500))), np.zeros(BUCKETS, np.int64)) < LEAST_ROWS
    parts = [x[~rare[x]] for x in parts]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    return Chain(categories, fit_chain(np.concatenate(parts), owner, y, fold))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, p_<category> of each, is_<category>, and the columns named in keep.

    A null or empty text has no features: its probabilities are those of the
    intercepts, and it is in no category. Row in, row out: repeated rows come
    out as often, a null doc_id stays null. An empty table gives no rows; texts of any length
    are read whole; columns that keep does not name are not read, whatever their names. No shuffle.
    """
    lean_batches(docs.sparkSession)
    slots, names = chain.slots(), chain.categories
    cuts = np.array([m.cut for m in chain.models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            part = np.zeros((b.num_rows, len(names)))
            some = np.zeros(b.num_rows, bool)
            for i, t in enumerate(b.column(1)):
                seen: set[int] = set()
                words = set(_words(t.as_py().lower()))
                for w in words:
                    f = cache.get(w)
                    if f is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        f = cache[w] = tuple(x for x in features(w) if x in slots)
                    if f:
                        seen.update(f)
                some[i] = bool(words)
                for x in sorted(seen):
                    part[i] += slots[x]
            p = chain.probabilities(part)
            out = [b.column(0), *(pa.array(p[:, i]) for i in range(len(names))), *(pa.array((p[:, i] > cuts[i]) & some) for i in range(len(names))), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *(f"p_{c}" for c in names), *(f"is_{c}" for c in names), *[f"kept_{i}" for i in range(len(keep))]])

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    kinds = [f"kept_{i} {d.schema[f'kept_{i}'].dataType.simpleString()}" for i in range(len(keep))]
    schema = ", ".join([f"doc_id {d.schema['doc_id'].dataType.simpleString()}", *(f"p_{c} double" for c in names), *(f"is_{c} boolean" for c in names), *kinds])
    return d.mapInArrow(run, schema).withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rated.select("doc_id", "p_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
