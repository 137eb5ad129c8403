"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a 32-bit universe make all coordinates of a signature: the
first spreads the shingles, the second, shifted circularly by k, gives
coordinate k. Bands of coordinates are the buckets of candidates.

No bucket's pairs are all written out. Documents of equal shingle sets are one
class. In a round, each bucket has one class as its centre, and the others are
compared with it; a class starts with the centre it shares most buckets with.
Confirmed links give components, and later rounds, with other centres, compare
only across components. At last, each class outside the commonest component of
its bucket is compared with all other components there, so that no link that
the buckets hold is lost. Seven bits of each of 154 coordinates rule out hopeless
pairs before whole shingle sets are fetched, which are then compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.components import components
from tessera.llm.shared import forget, texts, written

#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
#: Integers of seven coordinates of the sketch, and how many coordinates must agree: at 0.8, 123 are expected with a deviation of 5.
SKETCH, AGREE = 22, 100
#: Rows of a bucket that go to one task; the rows of larger buckets are dealt out by a hash.
SPLIT = 1_000
#: Rounds with one centre for each bucket, and how far labels spread after each; the last call spreads them to the end.
ROUNDS, LABEL_STEPS = 3, 2
#: Counters that say how common a shingle is (1 MB for each of 4 bytes a million); shingles share them by their hash.
COUNTERS, COUNTING_TASKS = 1 << 20, 8
#: Words that a worker remembers; beyond it starts anew.
CACHE = 60_000

_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_BYTES = np.int64(1) << (8 * np.arange(7, dtype=np.int64))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of size words; with fewer words, of the whole sequence.

    Words are split at ASCII white space after A-Z are lower-cased.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(cache) > CACHE:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = _mix(s * _A + h[i : i + n])
    return np.unique(s)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least of the second permutation over the first one's values shifted by k."""
    first = (shingles * _A >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 1024):
        x = first[None, at : at + 1024] + shift  # modulo the universe
        x ^= x >> np.uint32(16)
        x *= _M1
        x ^= x >> np.uint32(13)
        x *= _M2
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _B + rows[:, i])
    return key.view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest (of the whole set), bands, sketch; without words n is 0 and the rest null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            n, digests, bands, sketches = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), size, cache)
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                sig = signature(s, BANDS * ROWS)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(sig))
                sketches.append((sig[: SKETCH * 7] >> np.uint32(25)).astype(np.int64).reshape(SKETCH, 7) @ _BYTES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, digest binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles of the documents that ids (column id) names; the others, but for a Bloom filter's few, are not hashed again."""
    packed, _ = bloom.build(ids, "id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            got = [shingle_set(t.as_py(), size, cache).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["doc_id", "shingles"])

    some = docs.where(bloom.may_hold(docs.sparkSession, packed)(F.col("doc_id")))
    return some.mapInArrow(run, f"doc_id {kind}, shingles binary").join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id", "shingles"])


def _alike(a: Column, b: Column) -> Column:
    """Whether enough coordinates of two sketches agree: a byte of the difference that is not 0 carries into its top bit."""
    carry, top = (sum(x << 8 * i for i in range(7)) for x in (0x7F, 0x80))
    differ = [F.bit_count((F.get(a, i).bitwiseXOR(F.get(b, i)) + F.lit(carry)).bitwiseAND(F.lit(top))) for i in range(SKETCH)]
    return sum(differ[1:], differ[0]) <= 7 * SKETCH - AGREE


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree often enough."""
    a, b = (sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_alike(F.col("sa"), F.col("sb"))).select("a", "b")


def _rarest(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, shingle, place: of each set so many of the rarest ones that a similar set must have one of them."""
    top = np.uint64(64 - COUNTERS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for x in b.column(0):
                at, n = np.unique((np.frombuffer(x.as_py(), np.uint64) >> top).astype(np.int64), return_counts=True)
                own[at] += n.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["own"])

    total = np.zeros(COUNTERS, np.uint64)
    for r in sets.select("shingles").coalesce(COUNTING_TASKS).mapInArrow(count, "own binary").toLocalIterator():
        total += np.frombuffer(r["own"], np.uint32)
    sent = sets.sparkSession.sparkContext.broadcast(total.astype(np.uint32))
    kind = sets.schema["doc_id"].dataType.simpleString()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = []
                for x in b.column(1):
                    s = np.frombuffer(x.as_py(), np.uint64)
                    least = -(-num * len(s) // den)
                    out.append(s[np.lexsort((s, common[(s >> top).astype(np.int64)]))[: len(s) - least + 1]])
                sizes = [len(x) for x in out]
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(out)), sizes))), pa.array(np.concatenate(out).view(np.int64)), pa.array(places)], ["a", "shingle", "place"])

    return sets.select("doc_id", "shingles").mapInArrow(rare, f"a {kind}, shingle long, place int")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of which den * intersection >= num * union, on whole sets."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column(2), x.column(3)):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _spread(per_key: DataFrame) -> DataFrame:
    """A row a key with how many parts its bucket has becomes a row a part, to be joined on (key, part)."""
    return per_key.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _repeated_ids(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes that the texts of one id are in."""
    names = some.join(reps, "digest").select("doc_id", "id").distinct()
    several = names.groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("doc_id", "a")
    return names.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))


def near_duplicates(df: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (it is the row's own).

    Linked are rows with den * intersection >= num * union of their shingle
    sets. A null text or one without words is linked with nothing. Rows that
    share an id are one document, so their texts are linked. Repeated rows come
    out as often; texts of any length are compared whole; an empty table gives no
    rows; columns that are not named are not read. A null id is passed over as a component's name; a set that
    only rows with null ids have is linked with nothing, and its name is null.
    """
    docs = texts(df, id_col, text_col)
    signed = written(_signed(docs, size), "signed")
    some = signed.where("n > 0")
    first = F.min_by(F.struct("n", "bands", "sketch"), "doc_id").alias("x")
    reps = written(some.groupBy("digest").agg(F.min("doc_id").alias("id"), first), "classes")
    classes = reps.where("id is not null").select("id", "x.n", "x.bands", "x.sketch")
    sketches = classes.select("id", "sketch")
    buckets = classes.select("id", "n", F.explode("bands").alias("key"))
    several = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / SPLIT).cast("int")
    rows = buckets.join(several, "key").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), parts.alias("parts"), F.col("id").alias("a"), "n", F.col("id").alias("label"))
    rows = written(rows, "buckets")
    sets = written(_sets(docs, rows.select(F.col("a").alias("id")).distinct(), size), "sets")
    close = lambda x, y: (den * F.least(x, y) >= num * F.greatest(x, y))
    edges = written(_repeated_ids(some, reps.select("digest", "id")), "links")
    label = None
    for r in range(ROUNDS + 1):
        if r:
            rows = rows.drop("label").join(label.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
            mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("parts").alias("parts")).where("lo <> hi").select("key", "parts")
            rows = written(rows.join(_spread(mixed), ["key", "part"]), "buckets")
        if r < ROUNDS:
            at = F.min(F.struct(F.xxhash64("a", F.lit(r)).alias("h"), "a", "n", "label"))
            centre = _spread(rows.groupBy("key").agg(at.alias("c"), F.max("parts").alias("parts"))).select("key", "part", F.col("c.a").alias("b"), F.col("c.n").alias("nb"), F.col("c.label").alias("lb"))
            pairs = rows.join(centre, ["key", "part"]).where((F.col("label") != F.col("lb")) & close(F.col("n"), F.col("nb"))).groupBy("a", "b").agg(F.count("*").alias("m"))
            if not r:
                pairs = pairs.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        else:
            pairs = _apart(rows, sets, num, den)
        pairs = written(_agreeing(pairs.select("a", "b"), sketches), "pairs")
        edges = edges.unionByName(written(_linked(pairs, sets, num, den), "links"))
        label = components(edges, label, LABEL_STEPS if r < ROUNDS else None)
        forget(pairs)
    forget(rows, sets)  # what is left to read are the signatures, the classes' names and the labels
    out = signed.select("doc_id", "n", "digest").join(reps.select("digest", "id"), "digest", "left").join(label, F.col("id") == F.col("node"), "left")
    component = F.coalesce("label", "id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _apart(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the pairs of different labels that may be alike, of which one is outside the commonest label of a bucket.

    A similar pair shares one of each one's rarest shingles. Those of a shingle that
    more than SPLIT classes have are dealt out, the ones outside going to each part.
    """
    common = rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.max("parts").alias("parts")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("x"), F.max("parts").alias("parts"))
    common = _spread(common.select("key", F.col("x.label").alias("common"), "parts"))
    left = rows.join(common, ["key", "part"]).groupBy("a").agg(F.max(F.col("label") != F.col("common")).alias("apart"), F.first("n").alias("n"), F.first("label").alias("label"))
    left = written(left, "left")
    own = sets.join(left.select("a"), F.col("doc_id") == F.col("a"), "left_semi")
    rare = written(_rarest(own, num, den).join(left, "a"), "rarest")
    hot = rare.groupBy("shingle").agg(F.count("*").alias("m")).where(F.col("m") > SPLIT).select("shingle", F.ceil(F.col("m") / SPLIT).cast("int").alias("parts"))
    dealt = rare.join(hot, "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = dealt.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    some = _spread(dealt.where("apart").select("shingle", "parts", F.col("a").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("place").alias("px")))
    once = ~F.col("apart") | (F.col("x") < F.col("a"))
    shared = F.ceil((F.col("n") + F.col("nx")) * F.lit(num) / F.lit(num + den) - 1e-9)  # shingles that a similar pair shares at least
    ahead = (F.col("place") <= F.col("n") - shared) & (F.col("px") <= F.col("nx") - shared)
    pairs = some.join(every, ["shingle", "part"]).where(once & (F.col("label") != F.col("lx")) & ahead & (den * F.least("n", "nx") >= num * F.greatest("n", "nx")))
    return pairs.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, num=80, den=100)
