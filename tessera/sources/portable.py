"""Portable saves: JSON files of entries and bookmarks, checked as a whole.

A file fails at its first bad entry with a stable reason. Values come out of
the JSON as a variant, so that integers, booleans and strings stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_string
from tessera.operators.lines import entry_id

# Limits of an import.
MAX_BYTES, MAX_DEPTH, MAX_ENTRIES, MAX_BOOKMARKS, MAX_PAGE, MAX_TEXT, MAX_STRING, MAX_PARAGRAPH = 10 << 20, 64, 200_000, 10_000, 2_000, 20_000, 500, 16
CONFIDENCES = ["high", "medium", "low"]


def read_saves(spark: SparkSession, path: str) -> DataFrame:
    """path, json of each file; those over the size limit with a null text and their size."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.when(F.col("length") <= MAX_BYTES, F.decode("content", "UTF-8")).alias("json"))


def depth(json: Column) -> Column:
    """How deep objects and lists nest, strings left out."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(brackets, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    top = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, top, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _whole(v: Column, path: str, least: int) -> Column:
    x = F.try_variant_get(v, path, "variant")
    n = F.when(_kind(x) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.when(n >= least, n)


def _string(v: Column, path: str, limit: int) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(_kind(x) == "STRING", clean_string(F.try_variant_get(v, path, "string"), limit))


def analyzed(saves: DataFrame, key: str = "path", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(files, entries). files: key, reason (null if good), schema_version, needs_migration, doc_type, title, source_sha256, n_entries,
    warnings; entries: those of good files."""
    top = saves.select(key, F.col(json).alias("j"), F.try_parse_json(json).alias("v"))
    version = F.when(_kind(F.try_variant_get("v", "$.schema_version", "variant")) == "BIGINT", F.try_variant_get("v", "$.schema_version", "bigint"))
    is_list = lambda p: F.coalesce(_kind(F.try_variant_get("v", p, "variant")).startswith("ARRAY"), F.lit(False))
    items = F.try_variant_get("v", "$.entries", "array<variant>")
    marks = F.try_variant_get("v", "$.bookmarks", "variant")
    head = top.withColumns({"version": version, "items": items, "depth": F.when(F.col("v").isNotNull(), depth(F.col("j")))}).withColumn(
        "reason",
        F.when(F.col("j").isNull() | (F.octet_length("j") > MAX_BYTES), "too_large")
        .when(F.col("v").isNull() | ~F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False)), "invalid_json")
        .when(F.col("depth") > MAX_DEPTH, "too_deep")
        .when(F.col("version").isNull() | ~F.col("version").isin(1, 2), "unsupported_schema")
        .when(~is_list("$.entries"), "invalid_structure")
        .when(F.size("items") == 0, "empty")
        .when(F.size("items") > MAX_ENTRIES, "too_many_entries"),
    )
    each = head.where("reason is null").select(key, "version", F.posexplode("items").alias("ordinal", "e"))
    e = F.col("e")
    ref = F.when(_kind(F.try_variant_get(e, "$.ref", "variant")) == "STRING", _get(e, "$.ref", "string"))
    old_c, old_l = (F.try_element_at(F.regexp_extract_all(ref, F.lit(r"^\s*([0-9]{1,9})\s*:\s*([0-9]{1,9})\s*$"), F.lit(i)), F.lit(1)).cast("bigint") for i in (1, 2))
    kind = F.when(F.col("version") == 1, F.lit("grant")).otherwise(_get(e, "$.locator.kind", "string"))
    column = F.when(F.col("version") == 1, old_c).otherwise(_whole(e, "$.locator.column", 1))
    line = F.when(F.col("version") == 1, old_l).otherwise(_whole(e, "$.locator.printed_line", 1))
    box = F.try_variant_get(e, "$.box", "variant")
    b = F.try_variant_get(e, "$.box", "array<double>")
    numbers = F.coalesce(_kind(box).rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL.*)>$"), F.lit(False))
    good_box = numbers & (F.size(b) == 4) & (F.get(b, F.lit(0)) >= 0) & (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(2)) <= 1) & (F.get(b, F.lit(1)) >= 0) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3))) & (F.get(b, F.lit(3)) <= 1)
    conf = lambda p: F.coalesce(F.when(_get(e, p, "string").isin(CONFIDENCES), _get(e, p, "string")), F.lit("low"))
    rows = each.withColumns({
        "page_index": _whole(e, "$.page_index", 0), "source_text": _string(e, "$.source_text", MAX_TEXT), "shown": _string(e, "$.display_text", MAX_TEXT), "kind": kind, "column": column, "line": line,
        "paragraph": _string(e, "$.locator.paragraph", MAX_PARAGRAPH), "no_box": box.isNull() | (_kind(box) == "VOID"), "good_box": F.coalesce(good_box, F.lit(False)), "b": b,
        "text_confidence": conf("$.confidence"), "reference_confidence": conf("$.reference_confidence"),
    })
    located = F.coalesce(((F.col("kind") == "grant") & F.col("column").isNotNull() & F.col("line").isNotNull()) | ((F.col("kind") == "application") & F.col("paragraph").isNotNull()), F.lit(False))
    bad = (
        F.when(~F.coalesce(_kind(e).startswith("OBJECT"), F.lit(False)) | F.col("page_index").isNull() | (F.col("page_index") >= MAX_PAGE) | F.col("source_text").isNull(), "invalid_entry")
        .when(~located, "invalid_locator").when(~F.col("no_box") & ~F.col("good_box"), "invalid_box")
    )
    rows = rows.withColumn("bad", bad)
    worst = rows.groupBy(key).agg(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("ordinal"))).alias("bad"), F.count("*").alias("n_entries"), F.bool_or(F.col("kind") == "grant").alias("g"), F.bool_or(F.col("kind") == "application").alias("a"))
    sha, title = F.try_variant_get("v", "$.source.sha256", "string"), _string(F.col("v"), "$.title", MAX_STRING)
    files = head.join(worst, key, "left")
    reason = F.coalesce("reason", "bad", F.when(marks.isNotNull() & (_kind(marks) != "VOID") & ~is_list("$.bookmarks"), "invalid_structure").when(F.size(F.try_variant_get("v", "$.bookmarks", "array<variant>")) > MAX_BOOKMARKS, "too_many_bookmarks"))
    warn = F.array_compact(F.array(F.when(F.col("version") == 1, "migrated"), F.lit("unverified"), F.when(F.col("g") & F.col("a"), "mixed_locators")))
    out = files.withColumn("why", reason).select(
        key, F.col("why").alias("reason"), F.col("version").alias("schema_version"), (F.col("version") == 1).alias("needs_migration"), F.when(F.col("a") & ~F.col("g"), "application").otherwise("grant").alias("doc_type"),
        title.alias("title"), F.when(sha.rlike("^[0-9a-fA-F]{64}$"), sha).alias("source_sha256"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.when(F.col("why").isNull(), warn).alias("warnings"),
    )
    good = rows.join(out.where("reason is null").select(key), key, "left_semi")
    entries = good.select(
        key, "ordinal", entry_id(F.col("ordinal")).alias("entry_id"), F.col("page_index").cast("int").alias("page_index"), "kind", "column", "line", F.when(F.col("kind") == "application", F.col("paragraph")).alias("paragraph"),
        F.when(~F.col("no_box"), F.struct(*[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])).alias("box"), "source_text", F.coalesce("shown", "source_text").alias("display_text"), "text_confidence", "reference_confidence",
    )
    return out, entries


def bookmarks(saves: DataFrame, entries: DataFrame, key: str = "path", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(resolved, dropped): bookmarks by entry index, else by the first entry of their printed reference."""
    each = saves.select(key, F.posexplode(F.try_variant_get(F.try_parse_json(json), "$.bookmarks", "array<variant>")).alias("position", "m")).join(entries.select(key).distinct(), key, "left_semi")
    m = F.col("m")
    rows = each.select(key, "position", _whole(m, "$.entry_index", 0).cast("int").alias("i"), F.trim(_get(m, "$.ref", "string")).alias("r"), _string(m, "$.label", MAX_STRING).alias("label"), _string(m, "$.color", MAX_STRING).alias("color"))
    ref = F.when(F.col("kind") == "grant", F.concat_ws(":", "column", "line")).otherwise(F.concat(F.lit("["), "paragraph", F.lit("]")))
    first = entries.groupBy(key, ref.alias("r")).agg(F.min_by("entry_id", "ordinal").alias("by_ref"))
    both = rows.join(entries.select(key, F.col("ordinal").alias("i"), F.col("entry_id").alias("by_index")), [key, "i"], "left").join(first, [key, "r"], "left")
    both = both.withColumn("entry_id", F.coalesce("by_index", "by_ref"))
    return both.where("entry_id is not null").select(key, "position", "entry_id", "label", "color"), both.where("entry_id is null").select(key, "position")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
