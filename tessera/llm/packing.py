"""Packing of token sequences into windows by minimum bin slack.

Documents are cut into full windows and a rest shorter than one. What packing
needs to know of the rests is how many there are of each length, a histogram of
less than a window's number of rows. For each next window the longest rest left
is set, and a bitset subset-sum over the lengths that are left, each as often as
it is left, finds the multiset that fills the window closest to its capacity;
its counts are backtracked from the bitsets. The same multiset is best as long
as all its lengths last, so it is taken for as many windows as they allow, and
the number of steps follows the number of lengths, not that of documents.
Where no multiset fills a window, one more rest is cut to fill it, and what is
left of it is a rest of another length.

Rests of a length are numbered without bringing them together: each (length,
salt) group is numbered by itself and begins after the groups before it. The
steps, a small table, then say where the n-th rest of a length goes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import texts, written
from tessera.llm.token_counts import byte_letters

#: Rests of one length that are numbered together, about; a commoner length has several groups.
GROUP_ROWS = 500
#: Characters that are encoded at once; longer texts are cut before a space, where no pre-token goes on.
CHUNK = 1 << 20
#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_space = re.compile(r"(?<=[!-~]) ")


class Encoder:
    """encode(text) as the tokenizers library gives it for one .json file, without special tokens around.

    A byte-level vocabulary whose ids follow its merges is put to the tiktoken
    library, which gives the same ids in a fraction of the time; any other goes
    through tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        self.width = "H" if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0) < 1 << 16 else "I"
        if self._ranked(spec):
            import tiktoken

            byte_of = {c: b for b, c in byte_letters().items()}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self._encode = lambda text: own.encode(text, allowed_special="all")
            self._chunks = self._cut
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            self._encode = lambda text: tok.encode(text, add_special_tokens=False).ids
            self._chunks = lambda text: [text]

    @staticmethod
    def _ranked(spec: dict) -> bool:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        if not (plain and level and added) or spec["normalizer"]:
            return False
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        special = {t["content"] for t in spec["added_tokens"]}
        made = sorted((i, s) for s, i in model["vocab"].items() if len(s) > 1 and s not in special)
        return [s for _, s in made] == merges and set(byte_letters().values()) <= set(model["vocab"])

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK:
            m = _space.search(text, at + CHUNK)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> array:
        out = array(self.width)
        for part in self._chunks(text):
            out.extend(array(self.width, self._encode(part)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length, of left[length] at most, sum closest to capacity without passing it.

    Longer lengths come first, so that short ones are kept for later windows.
    """
    reach, layers, mask = 1, [], (1 << capacity + 1) - 1
    for length in sorted((x for x in left if x <= capacity and left[x] > 0), reverse=True):
        most, part = min(left[length], capacity // length), 1
        while most:
            part = min(part, most)
            layers.append((length, part, reach))
            reach |= reach << length * part & mask
            most, part = most - part, part * 2
        if reach >> capacity & 1:
            break
    at, counts = reach.bit_length() - 1, {}
    for length, part, before in reversed(layers):
        if not before >> at & 1:
            at -= length * part
            counts[length] = counts.get(length, 0) + part
    return counts


class Plan:
    """Where the n-th rest of each length goes: entries (length, first, sequence, each, offset, taken, onward).

    Rests of length numbered first and on go, each of them a sequence, from
    offset on into the sequences from sequence on. If fewer than length ids are
    taken, the others are the rest numbered onward (and on) of that length.
    """

    def __init__(self, counts: dict[int, int], window: int, first: int = 0):
        self.left = {x: n for x, n in counts.items() if x and n}
        self.given = {x: 0 for x in self.left}  # how many of a length have gone
        self.entries: list[tuple[int, ...]] = []
        self.next = first
        while self.left:
            seed = max(self.left)
            use = fill({x: n - (x == seed) for x, n in self.left.items()}, window - seed)
            use[seed] = use.get(seed, 0) + 1
            slack = window - sum(x * n for x, n in use.items())
            cut = max((x for x, n in self.left.items() if n > use.get(x, 0)), default=0) if slack else 0
            if slack and not cut:
                self._close(sorted(x for x, n in self.left.items() for _ in range(n)))
                break
            times = min(self.left[x] // (use.get(x, 0) + (x == cut)) for x in {*use, cut} - {0})
            offset = 0
            for x in sorted(use, reverse=True):
                self._take(x, use[x], offset, times)
                offset += x * use[x]
            if cut:
                self._take(cut, 1, offset, times, slack)
            self.next += times

    def _take(self, length: int, each: int, offset: int, times: int, taken: int = 0) -> None:
        first, onward = self.given[length], -1
        self.given[length] += each * times
        self.left[length] -= each * times
        if taken and taken < length:
            rest = length - taken
            onward = self.given.setdefault(rest, 0) + self.left.get(rest, 0)
            self.left[rest] = self.left.get(rest, 0) + times
        self.entries.append((length, first, self.next, each, offset, taken or length, onward))
        if not self.left[length]:
            del self.left[length]

    def _close(self, lengths: list[int]) -> None:
        """What does not fill a window any more is cut into sequences of powers of two, the largest first."""
        total = sum(lengths)
        while total:
            size = 1 << total.bit_length() - 1
            at = 0
            while at < size:
                x = lengths.pop()
                taken = min(x, size - at)
                self._take(x, 1, at, 1, taken)
                if taken < x:
                    lengths.append(x - taken)
                at += taken
            self.next += 1
            total -= size

    def table(self) -> np.ndarray:
        rows = np.array(sorted(self.entries), np.int64).reshape(-1, 7)
        return np.concatenate([rows, (rows[:, :1] << _RANK) + rows[:, 1:2]], axis=1)


#: Bits for the number of a rest among those of its length; more than 2e14 of them are beyond it.
_RANK = 48


def places(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(which, start, taken, sequence, offset) of the pieces of the rests, those that were cut in several turns."""
    which, start = np.flatnonzero(length), np.zeros(len(length), np.int64)
    length, rank = length.copy(), rank.copy()
    while len(which):
        at = np.searchsorted(table[:, 7], (length[which] << _RANK) + rank[which], side="right") - 1
        _, first, sequence, each, offset, taken, onward, _ = table[at].T
        turn, slot = np.divmod(rank[which] - first, each)
        yield which, start[which], taken, sequence + turn, offset + slot * length[which]
        more = onward >= 0
        start[which] += taken
        length[which] -= taken
        rank[which[more]] = (onward + turn)[more]
        which = which[more]


def _encoded(docs: DataFrame, path: str, window: int, end_id: int | None) -> DataFrame:
    """doc_id, ids (little-endian, of the encoder's width), full (windows), rest (length), row (a number of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                got = []
                for t in b.column(1):
                    ids = own.encode(t.as_py())
                    if end_id is not None:
                        ids.append(end_id)
                    got.append(ids)
                n = np.fromiter(map(len, got), np.int64, len(got))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in got], pa.binary()), pa.array(n // window), pa.array(n % window)], ["doc_id", "ids", "full", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, ids binary, full long, rest long").withColumn("row", F.monotonically_increasing_id())


def pack(df: DataFrame, path: str, window: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each id of each document, end_id after its last one included, is in one
    piece; a sequence's pieces follow each other without a gap from offset 0.
    All sequences hold window ids but the last few, whose lengths are powers of
    two. Documents are cut at full windows, and otherwise only where no
    multiset of rests fills a window. A null text is empty (end_id alone;
    without an end_id such a document has no piece). Repeated rows and rows
    with a null id are documents like others; texts of any length are encoded
    whole; an empty table gives no rows; other columns are not read.

    The ids are written once and shuffled once. About GROUP_ROWS
    rests are numbered together, however many have the same length; the driver and the
    tasks hold a histogram of window lengths and the steps over it.
    """
    if window < 1 or window >= 1 << 15:
        raise ValueError("window must be from 1 to 32,767")
    spark = df.sparkSession
    coded = written(_encoded(texts(df, id_col, text_col), path, window, end_id), "encoded")
    total = sorted(tuple(r) for r in coded.groupBy("rest").agg(F.count("*"), F.sum("full")).collect())  # a row a length
    salts = F.broadcast(spark.createDataFrame([(rest, -(-m // GROUP_ROWS)) for rest, m, _ in total], "rest long, salts long"))
    coded = coded.join(salts, "rest").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = coded.groupBy("rest", "salt").agg(F.count("*").alias("m"), F.sum("full").alias("f"))
    groups = written(groups.select("rest", "salt", "m", "f", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0")), "groups")
    fulls, windows = {}, 0
    for rest, _, f in total:
        fulls[rest] = windows
        windows += f
    plan = Plan({rest: m for rest, m, _ in total}, window, windows)
    sent = spark.sparkContext.broadcast((fulls, plan.table()))
    width = encoder(path).width
    own = Window.partitionBy("rest", "salt").orderBy("row")
    numbered = coded.select(
        "doc_id", "ids", "full", "rest", "salt", (F.row_number().over(own) - 1).alias("r"),
        F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"),
    ).join(groups.select("rest", "salt", "m0", "f0"), ["rest", "salt"])
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fulls, table = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                full, rest, rank, fore = (b.column(i).to_numpy() for i in (2, 3, 4, 5))
                ids = [np.frombuffer(x.as_py(), np.dtype(width).newbyteorder("<")).astype("<u4") for x in b.column(1)]
                begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
                which = np.repeat(np.arange(len(full)), full)
                turn = np.arange(len(which)) - begin[which]
                base = np.array([fulls[x] for x in rest.tolist()], np.int64) + fore
                parts = [(which, turn * window, np.full(len(which), window), base[which] + turn, np.zeros(len(which), np.int64))]
                parts += [(w, s + full[w] * window, n, q, o) for w, s, n, q, o in places(table, rest, rank)]
                which, start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts))
                cut = [ids[w][s : s + n].tobytes() for w, s, n in zip(which.tolist(), start.tolist(), length.tolist())]
                tokens = (full * window + rest)[which]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)), *map(pa.array, (start, length)), pa.array(cut, pa.binary()), *map(pa.array, (tokens, sequence, offset))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    rows = numbered.select("doc_id", "ids", "full", "rest", (F.col("r") + F.col("m0")).alias("rank"), (F.col("s") + F.col("f0")).alias("fore"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (binary, padded to window unless its length is a power of two), length: what a training run reads.

    A group holds one window of ids at most. No pieces give no rows.
    """
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    short = F.lit(4) * F.when(F.bit_count("length") == 1, 0).otherwise(F.lit(window) - F.col("length"))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (short / 4).cast("int")))
    return joined.select("sequence_id", F.concat(whole, pad).alias("ids"), "length")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
