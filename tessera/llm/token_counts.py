"""Token counts with a whole-token shortcut.

Offline, each vocabulary string that ends a word is put through the merges by
itself; those that come out as one token are proven whole. A pre-token found
among them counts one without any merging, only the rest are merged (once per
worker and cache fill).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import texts

#: Pre-tokens that a worker remembers of either kind of text; beyond it starts anew.
CACHE = 400_000


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """count(text) as the tokenizers library gives it for one .json file.

    Texts are cut here by the file's own pattern if all their characters are
    below U+0250, where the two libraries' tables of letters, cases and forms
    agree; other texts are cut by the library's own normaliser and pre-tokenizer.
    Either way a pre-token is looked up among the whole ones, and merged only if
    it is not there. Texts that hold an added token's string go through the
    library as a whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.far = regex.compile(r"[^\x00-ɏ]").search
        self.letters = byte_letters()
        self.cache: dict[str, int] = {}
        self.spelled_cache: dict[str, int] = {}
        suffix = spec["model"]["end_of_word_suffix"]
        ends = (s[: -len(suffix)] for s in spec["model"]["vocab"] if s.endswith(suffix))
        self.whole = {w for w in ends if w and self._merged(w) == 1}

    def _merged(self, spelled: str) -> int:
        return len(self.tok.model.tokenize(spelled))

    def _spelled(self, spelled: str) -> int:
        """Tokens of a pre-token in the letters of its bytes."""
        return 1 if spelled in self.whole else self._merged(spelled)

    def _word(self, word: str) -> int:
        return self._spelled("".join(map(self.letters.__getitem__, word.encode())))

    def _total(self, words: list[str], cache: dict[str, int], one: Callable[[str], int]) -> int:
        try:
            return sum(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = one(w)
            return sum(map(cache.__getitem__, words))

    def count(self, text: str) -> int:
        if any(a in text for a in self.added):
            return len(self.tok.encode(text, add_special_tokens=False))
        if self.far(text):
            cut = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
            return self._total([w for w, _ in cut], self.spelled_cache, self._spelled)
        return self._total(self.words(unicodedata.normalize("NFC", text).lower()), self.cache, self._word)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Row in, row out: repeated
    rows come out as often, a null doc_id stays null, other columns are not
    read. An empty table gives no rows; texts of any length are counted whole. No shuffle; a task holds one Arrow batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    docs = texts(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)
