"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has its own
piece probabilities, fitted by expectation maximisation on word counts. The
probability of a word is the sum over all its segmentations into pieces, which
the forward algorithm gives; a text's is the product over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import lean_batches

#: Longest stretch of a word that is learned from as one, and ends whose pieces are looked up at once. Scoring sums over whole words.
STRETCH, BLOCK = 24, 1024
#: Documents of each language that the probabilities are fitted on (a hash of the id picks about so many).
PER_LANGUAGE = 600
#: Rounds of expectation maximisation, and the pseudo-count of the pooled distribution.
ROUNDS, PRIOR = 4, 200.0
#: Words that a worker remembers; beyond it starts anew.
CACHE = 400_000
START = "▁"

_words = re.compile(r"[^\W\d_]+").findall


def stretches(word: str) -> list[str]:
    w = START + word
    return [w] if len(w) <= STRETCH else [w[i : i + STRETCH] for i in range(0, len(w), STRETCH)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """piece -> number, for lower-case pieces of letters with or without a word start; the last number is for any other single character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    fit = sorted(p for p in pieces if 0 < len(p) and p == p.lower() and (p == START or p.lstrip(START).isalpha()))
    return {p: i for i, p in enumerate(dict.fromkeys([START, *fit]))}


def longest(vocab: dict[str, int]) -> int:
    return max(map(len, vocab))


def lattice(words: list[str], vocab: dict[str, int]) -> np.ndarray:
    """words of one length n: [word, end - 1, length - 1] -> piece number, -1 for none."""
    n, get, other = len(words[0]), vocab.get, len(vocab)
    reach = min(n, longest(vocab))
    spans = [(e, k) for e in range(1, n + 1) for k in range(1, min(e, reach) + 1)]
    got = [[get(w[e - k : e], other if k == 1 else -1) for e, k in spans] for w in words]
    out = np.full((len(words), n, reach), -1, np.int32)
    at = np.array(spans).T
    out[:, at[0] - 1, at[1] - 1] = np.array(got, np.int32)
    return out


def forward(lat: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """alpha[word, language, end]: probability of all segmentations up to end. probs: [language, piece], its last column is 0, for none."""
    m, n, reach = lat.shape
    alpha = np.zeros((m, len(probs), n + 1))
    alpha[:, :, 0] = 1
    for e in range(1, n + 1):
        for k in range(1, min(e, reach) + 1):
            alpha[:, :, e] += alpha[:, :, e - k] * probs[:, lat[:, e - 1, k - 1]].T
    return alpha


def log_forward(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """[word, language]: the log of the probability of all segmentations of whole words of one length, however long.

    Only the last few ends are held, rescaled as they shrink; the pieces are looked up BLOCK ends at a time.
    """
    n, reach = len(words[0]), longest(vocab)
    last = [np.ones((len(words), len(probs)))]  # of the ends so far, the newest last
    logs = np.zeros((len(words), len(probs)))
    for at in range(0, n, BLOCK):
        start = max(0, at - reach + 1)
        lat = lattice([w[start : at + BLOCK] for w in words], vocab)
        for e in range(at, min(n, at + BLOCK)):
            row = lat[:, e - start]
            last.append(sum(last[-k] * probs[:, row[:, k - 1]].T for k in range(1, min(len(last), reach, row.shape[1]) + 1)))
            del last[:-reach]
            if e % 8 == 7:
                top = np.maximum(np.maximum.reduce(last), 1e-300)
                last = [x / top for x in last]
                logs += np.log(top)
    return logs + np.log(np.maximum(last[-1], 1e-300))


def expected(lat: np.ndarray, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts [language, piece] of words seen weight[word, language] times."""
    m, n, reach = lat.shape
    alpha = forward(lat, probs)
    beta = np.zeros_like(alpha)
    beta[:, :, n] = 1
    for e in range(n, 0, -1):
        for k in range(1, min(e, reach) + 1):
            beta[:, :, e - k] += beta[:, :, e] * probs[:, lat[:, e - 1, k - 1]].T
    scale = weight / np.maximum(alpha[:, :, n], 1e-300)
    out = np.zeros(probs.shape)
    for e in range(1, n + 1):
        for k in range(1, min(e, reach) + 1):
            at = lat[:, e - 1, k - 1]
            part = alpha[:, :, e - k] * probs[:, at].T * beta[:, :, e] * scale
            for i in range(len(probs)):
                out[i] += np.bincount(at % probs.shape[1], part[:, i], probs.shape[1])
    out[:, -1] = 0
    return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def fit_probabilities(counts: dict[str, np.ndarray], n_languages: int, vocab: dict[str, int]) -> np.ndarray:
    """[language, piece] with a last column of 0. counts: stretch -> times by language."""
    words = list(counts)
    groups = [(np.array(at), lattice([words[i] for i in at], vocab)) for at in by_length(words).values()]
    weight = np.array([counts[w] for w in words]).reshape(len(words), n_languages)
    size = len(vocab) + 2
    lengths = np.array([len(p) for p in vocab] + [1, 1])
    probs = np.tile(0.02 ** np.minimum(lengths, 4) + 1e-9, (n_languages, 1))
    probs[:, -1] = 0
    probs /= probs.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        c = np.zeros((n_languages, size))
        for at, lat in groups:
            c += expected(lat, probs, weight[at])
        pool = c.sum(axis=0) + 0.01
        pool[-1] = 0
        pool /= pool.sum()
        probs = c + PRIOR * pool
        probs /= probs.sum(axis=1, keepdims=True)
    return probs


class Model:
    def __init__(self, languages: list[str], probs: np.ndarray, path: str):
        self.languages, self.probs, self.path = languages, probs, path


class Scorer:
    """Remembers each word's log probabilities."""

    def __init__(self, model: Model):
        self.model, self.vocab = model, vocabulary(model.path)
        self.cache: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE:
            self.cache, self.logs, new = {}, self.logs[:0], list(words)
        flat = [START + w for w in new]
        total = np.zeros((len(new), len(self.model.languages)))
        for n, at in by_length(flat).items():
            step = max(1, 500_000 // n)
            for i in range(0, len(at), step):
                some = at[i : i + step]
                total[some] = log_forward([flat[j] for j in some], self.vocab, self.model.probs)
        self.cache.update(zip(new, range(len(self.logs), len(self.logs) + len(new))))
        self.logs = np.concatenate([self.logs, total])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        words = [_words(t.lower()) if t else [] for t in texts]
        self.learn(set().union(*words))
        for ws in words:
            # A run may be of numerals that are no decimal digits, such as fractions.
            if not self.model.languages or not (any(map(str.isalpha, ws)) or any(c.isalpha() for w in ws for c in w)):
                langs.append("und")
                scores.append(0.0)
                continue
            s = self.logs[np.fromiter(map(self.cache.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(np.argmax(s))
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(s - s[best]).sum()))
        return langs, scores


def fit(docs: DataFrame, path: str, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Piece probabilities of each non-null language of the rows that learn_from holds for.

    A hash of the id picks about per_language documents of each language;
    those are what the driver's word counts come from, at any table size.
    """
    train = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    vocab = vocabulary(path)
    counts: dict[str, np.ndarray] = {}
    if languages:
        share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
        draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
        picked = train.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("text"))
        words = picked.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        slot = {k: i for i, k in enumerate(languages)}
        for r in words.groupBy("lang", "word").count().collect():  # of the bounded sample alone
            for s in stretches(r["word"]):
                counts.setdefault(s, np.zeros(len(languages)))[slot[r["lang"]]] += r["count"]
    probs = fit_probabilities(counts, len(languages), vocab) if counts else np.zeros((len(languages), len(vocab) + 2))
    return Model(languages if counts else [], probs, path)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the posterior of equal priors).

    A null text or one without letters is `und` with score 0, as is every text
    if no language was learned. Equal scores take the first language by name.
    Row in, row out: repeated rows come out as often, a null doc_id stays null,
    other columns are not read, whatever their names. Texts and words of any length
    are summed over whole. An empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                langs, scores = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    lean_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id always is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
