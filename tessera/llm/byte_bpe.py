"""Byte-level BPE with a sentencepiece model made from a rank file.

Each byte becomes one character, each vocabulary string a piece whose score is
its negative rank, and the normaliser is the identity. sentencepiece merges the
adjacent pair of the highest score first and the leftmost of equal ones, which
is the merge order of the ranks. The text is cut by the pre-token pattern, each
pre-token is encoded by itself (once per worker and cache fill), and ids decode by the
inverse mapping from id to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import texts

#: Pre-tokens that a worker remembers; beyond it starts anew.
CACHE = 200_000
#: Texts that are encoded before their ids go out.
ROWS_AT_ONCE = 256
#: Byte b stands as the character of this code point plus b: no white space, and unchanged by the identity normaliser.
FIRST = 0x100


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_symbols(data: bytes) -> str:
    return data.decode("latin-1").translate(_SYMBOLS)


_SYMBOLS = {b: FIRST + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank file. Piece i is the i-th string by rank, the unknown piece comes last."""
    if len({*ranks} & {bytes([b]) for b in range(256)}) < 256:
        raise ValueError("the vocabulary must hold all 256 single bytes")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, as_symbols(s).encode()) + _field(2, float(-rank)) + _field(3, normal) for s, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(i, -1) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(i, 0) for i in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """encode() and decode() of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.words = regex.compile(pattern).findall
        self.whole = ranks
        self.rank_of = np.array(sorted(ranks.values()), dtype="<u4")
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for s, r in ranks.items():
            self.bytes_of[r] = s
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.cache: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        rest = []
        for w in new:  # a pre-token that is itself a vocabulary string is that token
            r = self.whole.get(w.encode())
            if r is None:
                rest.append(w)
            else:
                self.cache[w] = struct.pack("<I", r)
        for w, ids in zip(rest, self.model.encode([as_symbols(w.encode()) for w in rest], num_threads=1) if rest else ()):
            self.cache[w] = self.rank_of[ids].tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self.words(text)
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            self._learn([w for w in dict.fromkeys(words) if w not in cache])
            return b"".join(map(cache.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array of int, if keep_ids), n_tokens, ids_sha256, decoded_sha256, round_trip.

    A null text counts as empty: no ids, the digests of nothing. Row in, row
    out: repeated rows come out as often, a null doc_id stays null, other
    columns are not read. An empty table gives no rows; texts of any length are
    encoded whole. No shuffle; a task holds one Arrow batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                n, ids, a, b, same = [], [], [], [], []
                for text in batch.column(1):
                    text = text.as_py()
                    got = bpe.encode(text)
                    back = bpe.decode(got)
                    n.append(len(got) // 4)
                    a.append(hashlib.sha256(got).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
                    if keep_ids:
                        ids.append(got)
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if keep_ids:
                    ends = pa.py_buffer(array("i", [0, *accumulate(n)]))
                    values = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(ids))])
                    cols.append(pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(n) + 1, [None, ends]), values))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = texts(df, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
