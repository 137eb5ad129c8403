"""Reading a document: outline, claims, indents, paragraphs, references and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CLAIMS_START, SPECIFICATION_HEADING, claim_candidate, is_heading, is_heading_part, parse_ref


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows that no break parts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


def outline(lines: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal", place: Sequence[str] = (), most: int = 3) -> DataFrame:
    """keys, first, title: lines in capitals that follow each other in one place (page, column), joined by up to three.

    Kept are headings of a specification's parts, and other headings after the first of them.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    apart = F.coalesce(F.col(order) != F.lag(order).over(w) + 1, F.lit(True))
    for p in place:
        apart = apart | ~F.col(p).eqNullSafe(F.lag(p).over(w))
    runs = islands(lines.where(is_heading_part(F.col("text"))), keys, [order], apart)
    at = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(order)) - 1
    part = F.struct(order, F.trim("text").alias("t"))
    joined = runs.withColumn("chunk", F.floor(at / most)).groupBy(*keys, "island", "chunk").agg(F.min(order).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), " ").alias("title"))
    main = F.col("title").rlike(SPECIFICATION_HEADING)
    begun = F.max(main).over(Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumns({"_m": main, "_b": begun}).where(F.col("_m") | (F.col("_b") & is_heading(F.col("title")))).select(*keys, "first", "title")


def backward_claims(rows: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal", number: str = "number") -> DataFrame:
    """The best run of numbers that rise by exactly one from 1: of at least two, the longest, the last of equals."""
    w = Window.partitionBy(*keys).orderBy(order)
    follows = F.coalesce((F.col(number) == F.lag(number).over(w) + 1) & (F.col(number) > 1), F.lit(False))
    runs = islands(rows.where(F.col(number).isNotNull()), keys, [order], ~follows)
    size = Window.partitionBy(*keys, "island")
    rated = runs.withColumns({"_n": F.count("*").over(size), "_lo": F.min(number).over(size), "_last": F.max(order).over(size)}).where("_lo = 1 and _n >= 2")
    best = rated.groupBy(*keys).agg(F.max(F.struct("_n", "_last", "island")).alias("_b")).select(*keys, F.col("_b.island").alias("island"))
    return rated.join(best, [*keys, "island"], "left_semi").select(*keys, order, number)


def forward_claims(rows: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal", number: str = "number") -> DataFrame:
    """Numbers in order, each taken if it is the next one expected from 1."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(number).alias("n")))), lambda x: x)
    per = rows.where(F.col(number).isNotNull()).groupBy(*keys).agg(seq.alias("s"))
    kind = per.schema["s"].dataType.simpleString()
    took = F.aggregate("s", F.array().cast(kind), lambda acc, x: F.when(x["n"] == F.size(acc) + 1, F.concat(acc, F.array(x))).otherwise(acc))
    return per.select(*keys, F.explode(took).alias("x")).select(*keys, F.col("x.o").alias(order), F.col("x.n").alias(number))


def claims(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Forward claims, or backward ones where they are more."""
    f, b = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((forward_claims(rows, keys), "nf"), (backward_claims(rows, keys), "nb")))
    both = f.join(b, list(keys), "full").select(*keys, (F.coalesce("nb", F.lit(0)) > F.coalesce("nf", F.lit(0))).alias("_back"))
    back, front = (backward_claims(rows, keys), True), (forward_claims(rows, keys), False)
    parts = [x.join(both.where(F.col("_back") == want), list(keys), "left_semi") for x, want in (back, front)]
    return parts[0].unionByName(parts[1])


def claim_numbers(text: Column) -> Column:
    """Claim numbers of a provider's claims text: from 1 on, each the next one that starts a line."""
    got = F.transform(F.split(text, "\n"), claim_candidate)
    return F.aggregate(F.filter(got, lambda x: x.isNotNull()), F.array().cast("array<int>"), lambda acc, x: F.when(x == F.size(acc) + 1, F.concat(acc, F.array(x))).otherwise(acc))


def claims_start(lines: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal") -> DataFrame:
    """The first line that says what is claimed, on one line or over two."""
    w = Window.partitionBy(*keys).orderBy(order)
    both = F.concat_ws(" ", F.trim("text"), F.trim(F.lead("text").over(w)))
    hit = F.trim("text").rlike(CLAIMS_START) | both.rlike(CLAIMS_START)
    return lines.withColumn("_h", hit).where("_h").groupBy(*keys).agg(F.min(order).alias("claims_start"))


def indent_levels(entries: DataFrame, keys: Sequence[str], unit: float = 0.012, least: float = 0.006) -> DataFrame:
    """indent: half-up number of units (1 to 6) from the fifth-lowest part of the left edges of a page's column, 0 nearer than least."""
    low = entries.groupBy(*keys).agg(F.expr("percentile_disc(0.2) within group (order by left)").alias("_base"))
    off = F.greatest(F.col("left") - F.col("_base"), F.lit(0.0))
    return entries.join(low, list(keys)).withColumn("indent", F.when(off < least, 0).otherwise(F.least(F.lit(6), F.greatest(F.lit(1), F.floor(off / unit + 0.5).cast("int"))))).drop("_base")


def paragraph_starts(entries: DataFrame, keys: Sequence[str], order: str = "ordinal") -> DataFrame:
    """starts: entries flagged as starts (paragraph_start) whose source says so (paragraph_source), or that an indent or a gap of at
    least 1.6 of the upper median gap of the column bears out."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = entries.withColumn("_gap", F.col("y") - F.lag("y").over(w))
    gaps = F.array_sort(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap"))))
    typical = rows.groupBy(*keys).agg(gaps.alias("_g")).select(*keys, F.get("_g", F.floor(F.size("_g") / 2).cast("int")).alias("_t"))
    out = rows.join(typical, list(keys), "left")
    wide = F.coalesce(F.col("_gap") >= F.greatest(F.lit(0.018), 1.6 * F.col("_t")), F.lit(False))
    return out.withColumn("starts", F.coalesce("paragraph_start", F.lit(False)) & (F.col("paragraph_source").isNotNull() | (F.col("indent") > 0) | wide)).drop("_gap", "_t")


def application_starts(entries: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal") -> DataFrame:
    """starts: entries flagged as starts, or of another paragraph than the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce(F.col("paragraph") != "", F.lit(False)) & ~F.col("paragraph").eqNullSafe(F.lag("paragraph").over(w))
    return entries.withColumn("starts", F.coalesce("paragraph_start", F.lit(False)) | changed)


def find_ref(entries: DataFrame, ref: str) -> DataFrame:
    """The first entry at `c:l`."""
    r = parse_ref(F.lit(ref))
    return entries.where((F.col("column") == r["column"]) & (F.col("line") == r["line"])).orderBy("ordinal").limit(1)


def export_text(entries: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal") -> DataFrame:
    """One text a document: reference, tab, line, in order."""
    row = F.struct(order, F.concat_ws("\t", "ref", "display_text").alias("t"))
    return entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n").alias("text"))


def export_portable(entries: DataFrame, bookmarks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "ordinal") -> DataFrame:
    """One JSON a document, version 2: entries in order, bookmarks by printed reference."""
    e = F.array_sort(F.collect_list(F.struct(order, "ref", "source_text", "display_text", "page_index")))
    per = entries.groupBy(*keys).agg(e.alias("entries"))
    b = bookmarks.join(entries.select(*keys, "entry_id", "ref", order), [*keys, "entry_id"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ref", "label", "color"))).alias("bookmarks"))
    rows = per.join(b, list(keys), "left")
    none = F.array().cast(b.schema["bookmarks"].dataType)
    return rows.select(*keys, F.to_json(F.struct(F.lit(2).alias("schema_version"), "entries", F.coalesce("bookmarks", none).alias("bookmarks"))).alias("json"))


def marks(entries: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end, names: the parts between all ends of an entry's spans, each with what covers it."""
    length = F.length("text")
    cuts = spans.select(*keys, F.explode(F.array("start", "end")).alias("at")).union(entries.select(*keys, F.explode(F.array(F.lit(0), length)).alias("at"))).distinct()
    w = Window.partitionBy(*keys).orderBy("at")
    parts = cuts.withColumn("to", F.lead("at").over(w)).where("to is not null")
    over = parts.join(spans.withColumnsRenamed({"start": "_s", "end": "_e"}), list(keys), "left").withColumn("_in", F.coalesce((F.col("_s") <= F.col("at")) & (F.col("to") <= F.col("_e")), F.lit(False)))
    return over.groupBy(*keys, "at", "to").agg(F.array_sort(F.collect_list(F.when(F.col("_in"), F.col("name")))).alias("names")).withColumnsRenamed({"at": "start", "to": "end"})


def next_match(at: Column, step: Column, n: Column) -> Column:
    """The place after step moves among n matches, around the ends."""
    return F.when(n > 0, F.pmod(at + step, n))


def chunks(texts: DataFrame, keys: Sequence[str], order: str, limit: int = 2000) -> DataFrame:
    """chunk: consecutive texts up to max(2000, limit) characters together; one that would pass it starts the next."""
    most = max(2000, limit)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length("text").alias("n"))))
    per = texts.groupBy(*keys).agg(rows.alias("r"))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))

    def step(acc, x):
        full = (acc["sum"] > 0) & (acc["sum"] + x["n"] > most)
        c = F.when(full, acc["c"] + 1).otherwise(acc["c"])
        return F.struct(c.alias("c"), F.when(full, x["n"]).otherwise(acc["sum"] + x["n"]).alias("sum"), F.concat(acc["all"], F.array(c)).alias("all"))

    folded = F.aggregate("r", start, step, lambda acc: acc["all"])
    return per.select(*keys, F.explode(F.arrays_zip(F.col("r"), folded.alias("c"))).alias("x")).select(*keys, F.col("x.r.o").alias(order), F.col("x.c").alias("chunk"))
