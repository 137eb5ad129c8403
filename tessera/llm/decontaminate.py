"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window is as many words of a document as an item has; only the end of the
document may cut it. Documents are scanned once for the places where a shingle
of an item stands, whatever its place in the item. Windows that begin at such a
place and hold enough of them to reach the limit are formed in a second pass
over the documents that have some. A window that begins elsewhere is no better
than the next one that begins at such a place, so no document is lost. Windows
and items get 64-bit SimHash fingerprints. Cut into RADIUS + 1 blocks, two
fingerprints within RADIUS bits agree on a whole block, so a join on blocks finds
them all. Candidates within the radius are verified by the exact similarity of
their shingles weighted by how often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import row_key, written

WORD = r"[\p{L}\p{N}]+"
#: At a similarity of 0.8, 9.7 of the 64 bits differ on average, with a deviation of 2.9; 24 is five deviations off.
RADIUS = 24
#: Item shingles up to which they are broadcast (about 40 bytes each); more are joined by shuffle.
BROADCAST_SHINGLES = 400_000
#: Window starts up to which the documents that have some are found by a broadcast; with more, texts are shuffled.
BROADCAST_STARTS = 400_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingle(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(size)])


def shingles(w: Column, size: int) -> Column:
    """Hashes of all shingles of size words, in order."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: _shingle(w, i, size))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more shingles have it set than not; repeated shingles weigh as often as they occur."""

    def bit(acc: Column, b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.call_function("getbit", h, b) == 1, 1).otherwise(-1))
        return acc.bitwiseOR(F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit), F.lit(0).cast("long"))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 structs (number, bits) that part the fingerprint."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    cut = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("number"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets of hashes."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def matches(df: DataFrame, benchmark: DataFrame, size: int = 5, num: int = 80, den: int = 100, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, row_key, item_id, start (word number), length (words of the item), intersection, union of every window that
    begins with a shingle of an item of its length and that den * intersection >= num * union holds for.

    Words are runs of letters and digits, in lower case. An item of fewer than
    size words is one shingle of all its words. Items without words, or with a
    null id, and texts that are null or without words match nothing. Rows that
    repeat an item count once, items of one id with unequal texts each; repeated
    documents are reported once, with the key of their text. Texts of any length are
    read whole; an empty table on either side gives no rows; columns that are not
    named are not read.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.coalesce(F.col(item_text), F.lit(""))).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lengths = [r["k"] for r in items.select(F.least(F.size("w"), F.lit(size)).alias("k")).distinct().orderBy("k").collect()]
    found = None
    for k in lengths:
        one = _found(docs, items.where(F.least(F.size("w"), F.lit(size)) == k), k, num, den, radius)
        found = one if found is None else found.union(one)
    if found is None:
        kind, key = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, row_key long, item_id {key}, start int, length int, intersection int, union int")
    return found


def _found(docs: DataFrame, items: DataFrame, k: int, num: int, den: int, radius: int) -> DataFrame:
    items = items.select("item_id", F.size("w").alias("m"), shingles(F.col("w"), k).alias("sh")).select("item_id", "m", "sh", simhash(F.col("sh")).alias("fp"))
    anchors = items.select("m", F.size("sh").alias("s"), F.explode("sh").alias("h")).distinct()  # items of one size share them
    anchors = F.broadcast(anchors) if anchors.count() <= BROADCAST_SHINGLES else anchors
    texts = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), "text")
    # The words stay in the generated code that hashes them: what a join may shuffle is a row a shingle with its place and hash alone.
    # The outer form keeps the optimizer from cutting the text a second time to test for words.
    cut = texts.select("doc_id", "row_key", words(F.col("text")).alias("w"))
    rows = cut.select("doc_id", "row_key", "w", F.explode_outer(F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k))).alias("i")).where("i is not null")
    hit = rows.select("doc_id", "row_key", (F.size("w") - k + 1).alias("n"), "i", _shingle(F.col("w"), F.col("i"), k).alias("h")).join(anchors, "h")
    places = hit.groupBy("doc_id", "row_key", "n", "m", "s").agg(F.sort_array(F.collect_set("i")).alias("at"))

    def enough(a: Column, x: Column) -> Column:
        """Whether the window that begins at a, the x-th place, holds as many places as the limit takes."""
        least = F.ceil(num * (F.least(F.col("s"), F.col("n") - a) + F.col("s")) / (num + den)).cast("int")
        return F.coalesce(F.get("at", x + least - 1) < a + F.col("s"), F.lit(False))

    starts = places.select("doc_id", "row_key", "m", F.explode(F.filter("at", enough)).alias("start"))
    wanted = starts.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("m", "start")).alias("want"))
    wanted = written(wanted.withColumnsRenamed({"doc_id": "d", "row_key": "k"}), "decontaminate")
    few = (wanted.select(F.sum(F.size("want"))).first()[0] or 0) <= BROADCAST_STARTS
    some = texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")))
    some = some.select("doc_id", "row_key", words(F.col("text")).alias("w"), "want").select("doc_id", "row_key", "w", F.explode("want").alias("x"))
    m, start = F.col("x.m"), F.col("x.start")
    windows = some.select("doc_id", "row_key", m.alias("m"), start.alias("start"), F.slice("w", start + 1, F.least(m, F.size("w") - start)).alias("w"))
    windows = windows.groupBy("doc_id", "row_key", "m", "start").agg(F.first("w").alias("w"))
    windows = windows.select("doc_id", "row_key", "m", "start", shingles(F.col("w"), k).alias("ws")).withColumn("wf", simhash(F.col("ws")))
    by_block = items.select("item_id", "m", "sh", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("item_id", "m", "sh", "fp", F.col("b.number").alias("number"), F.col("b.bits").alias("bits"))
    cuts = windows.select("doc_id", "row_key", "m", "start", "ws", "wf", F.explode(blocks(F.col("wf"), radius)).alias("b")).select("*", F.col("b.number").alias("number"), F.col("b.bits").alias("bits")).drop("b")
    near = cuts.join(by_block, ["m", "number", "bits"]).where(F.bit_count(F.col("wf").bitwiseXOR(F.col("fp"))) <= radius)
    both = shared(F.col("ws"), F.col("sh"))
    # Of the blocks that a pair agrees on, the first one speaks.
    differ = F.col("wf").bitwiseXOR(F.col("fp"))
    first = F.array_position(F.transform(blocks(differ, radius), lambda x: x["bits"]), F.lit(0).cast("long")) - 1
    scored = near.where(F.col("number") == first).select("doc_id", "row_key", "item_id", "start", F.col("m").alias("length"), both.alias("intersection"), (F.size("ws") + F.size("sh")).alias("total"))
    scored = scored.withColumn("union", F.col("total") - F.col("intersection")).where(den * F.col("intersection") >= num * F.col("union"))
    return scored.select("doc_id", "row_key", "item_id", "start", "length", "intersection", "union")


def contaminated(found: DataFrame) -> DataFrame:
    """doc_id, row_key, items (sorted), n_passages (windows that overlap are one) and the best similarity of each document that has matches."""
    windows = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    grown = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.when(x["start"] < acc["end"], 0).otherwise(1)).alias("n"))
    out = found.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), windows.alias("windows"), F.max(F.col("intersection") / F.col("union")).alias("similarity"))
    n = F.aggregate("windows", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), grown, lambda acc: acc["n"])
    return out.select("doc_id", "row_key", "items", n.alias("n_passages"), "similarity")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(matches(docs, items)).select("doc_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n_passages", "similarity")
