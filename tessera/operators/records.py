"""Smaller rules over stored records: annotations, numbers, names, completion of drawings, column splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import parse_identifier
from tessera.operators.lines import PAGE

# Most rectangles, ranges and points of an annotation.
MOST_PARTS, MOST_POINTS = 500, 2_000


def _number(v: Column, path: str) -> Column:
    """A JSON number, not a boolean or a string."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def _there(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return x.isNotNull() & (F.schema_of_variant(x) != "VOID")


def _unit(x: Column) -> Column:
    return F.coalesce(x.between(0, 1), F.lit(False))


def annotation_problem(kind: Column, geometry: Column) -> Column:
    """Why a geometry does not fit its kind (bookmark, note, highlight, drawing), else null."""
    v = F.try_parse_json(geometry)
    n = lambda p: _number(v, p)
    version = F.when(_there(v, "$.version"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.version", "variant")) == "BIGINT", F.try_variant_get(v, "$.version", "bigint"))).otherwise(F.lit(1))
    fits = lambda p, lo, hi: ~_there(v, p) | F.coalesce(n(p).between(lo, hi), F.lit(False))
    common = F.when(~F.coalesce(version.between(1, 2), F.lit(False)), "version").when(~fits("$.opacity", 0.1, 1), "opacity")
    point = (
        F.when(~_unit(n("$.x")) | ~_unit(n("$.y")), "point")
        .when(_there(v, "$.collapsed") & (F.schema_of_variant(F.try_variant_get(v, "$.collapsed", "variant")) != "BOOLEAN"), "collapsed")
        .when(~fits("$.width", 0, 1) | ~fits("$.height", 0, 1), "size")
    )
    edges = [n(f"$.{e}") for e in ("x0", "y0", "x1", "y1")]
    rects, ranges, points = (F.try_variant_get(v, f"$.{p}", "array<variant>") for p in ("rects", "text_ranges", "points"))
    r = lambda x, i: _number(x, f"$[{i}]")
    size = lambda x: F.size(F.try_variant_get(x, "$", "array<variant>"))
    good_rect = lambda x: F.coalesce((size(x) == 4) & _unit(r(x, 0)) & _unit(r(x, 1)) & _unit(r(x, 2)) & _unit(r(x, 3)) & (r(x, 2) > r(x, 0)) & (r(x, 3) > r(x, 1)), F.lit(False))
    text = lambda x, p: F.schema_of_variant(F.try_variant_get(x, p, "variant")) == "STRING"
    good_range = lambda x: F.coalesce(text(x, "$.entry_id") & (_number(x, "$.start") >= 0) & (_number(x, "$.start") <= _number(x, "$.end")) & (~_there(x, "$.quote") | text(x, "$.quote")), F.lit(False))
    listed = lambda p, xs, good: _there(v, p) & ~F.coalesce((F.size(xs) <= MOST_PARTS) & F.forall(xs, good), F.lit(False))
    highlight = (
        F.when(~(_unit(edges[0]) & _unit(edges[1]) & _unit(edges[2]) & _unit(edges[3])), "box").when((edges[2] <= edges[0]) | (edges[3] <= edges[1]), "area")
        .when(listed("$.rects", rects, good_rect), "rects").when(listed("$.text_ranges", ranges, good_range), "text_ranges")
    )
    pair = lambda x: F.coalesce((size(x) == 2) & _unit(r(x, 0)) & _unit(r(x, 1)), F.lit(False))
    drawing = F.when(~F.coalesce(F.size(points).between(2, MOST_POINTS), F.lit(False)), "points").when(~F.forall(points, pair), "pairs").when(~fits("$.stroke_width", 0.001, 0.03), "stroke")
    return F.when(v.isNull(), "json").otherwise(F.coalesce(common, F.when(kind.isin("bookmark", "note"), point).when(kind == "highlight", highlight).otherwise(drawing)))


def highlight_rects(geometry: Column) -> Column:
    """The rectangles of a highlight, else its one box, else none."""
    v = F.try_parse_json(geometry)
    rects = F.try_variant_get(v, "$.rects", "array<array<double>>")
    own = F.array(*[_number(v, f"$.{e}") for e in ("x0", "y0", "x1", "y1")])
    none = F.array().cast("array<array<double>>")
    return F.when(rects.isNotNull(), F.filter(rects, lambda x: (F.size(x) == 4) & F.forall(x, lambda y: y.isNotNull()))).when(F.forall(own, lambda x: x.isNotNull()), F.array(own)).otherwise(none)


def claim_numbers_valid(numbers: Column) -> Column:
    """Provider claim numbers from 1 to 999."""
    return F.filter(F.coalesce(numbers, F.array().cast("array<int>")), lambda n: n.between(1, 999))


def display_number(canonical: Column) -> Column:
    """The number as people write it, or as it is stored if it does not parse."""
    return F.coalesce(parse_identifier(canonical)["display"], canonical)


def workspace_name(name: Column) -> Column:
    """Single spaces, 1 to 120 characters, else null."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(F.length(n).between(1, 120), n)


def published(payloads: DataFrame) -> DataFrame:
    """Edited results with a known disposition; others count as complete with warnings."""
    known = F.col("disposition").isin("complete", "complete_with_warnings", "partial")
    return payloads.withColumn("disposition", F.when(F.coalesce(known, F.lit(False)), F.col("disposition")).otherwise("complete_with_warnings"))


def needs_fetch(jobs: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs whose document's source is to be fetched and has no file yet."""
    todo = sources.where((F.col("source_type") == "fetch") & F.col("pdf_object_key").isNull()).select("source_id")
    return jobs.join(documents.select("document_id", "source_id").join(todo, "source_id"), "document_id", "left_semi")


def completed_drawings(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Labels of drawing pages: a page's native ones where it has any, else the recognised ones."""
    rest = recognised.join(native.select(*PAGE).distinct(), PAGE, "left_anti")
    return native.withColumn("method", F.lit("native_text")).unionByName(rest)


def last_labels(labels: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Of labels of one key the last by position."""
    w = Window.partitionBy(*keys).orderBy(F.desc(position))
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def column_boundary(words: DataFrame, bins: int = 60) -> DataFrame:
    """PAGE, boundary: where two columns part.

    With 20 words or more, the least covered of the middle bins, if words cover
    it at most 0.4 times as often as the columns' own bins; with fewer, the middle
    of the widest gap between word centres near the page's, from 0.08 on.
    """
    bin_of = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(x * bins).cast("int")))
    n = F.count("*").over(Window.partitionBy(*PAGE))
    rows = words.withColumn("_n", n)
    cover = rows.where("_n >= 20").select(*PAGE, F.explode(F.sequence(bin_of(F.col("x0")), bin_of(F.col("x1")))).alias("b")).groupBy(*PAGE, "b").agg(F.count("*").alias("c"))
    grid = cover.select(*PAGE).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(cover, [*PAGE, "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    part = lambda lo, hi: F.median(F.when((F.col("b") >= int(lo * bins)) & (F.col("b") < int(hi * bins)), F.col("c")))
    middle = F.when(F.col("b").between(int(0.40 * bins), int(0.60 * bins)), F.struct("c", "b"))
    valley = grid.groupBy(*PAGE).agg(part(0.10, 0.45).alias("l"), part(0.55, 0.90).alias("r"), F.min(middle).alias("m"))
    deep = valley.where("l > 0 and r > 0").where(F.col("m.c") <= 0.4 * (F.col("l") + F.col("r")) / 2).select(*PAGE, ((F.col("m.b") + 0.5) / bins).alias("boundary"))
    cx = (F.col("x0") + F.col("x1")) / 2
    few = rows.where("_n < 20").withColumn("cx", cx)
    nxt = F.lead("cx").over(Window.partitionBy(*PAGE).orderBy("cx"))
    gaps = few.withColumns({"gap": nxt - F.col("cx"), "mid": (nxt + F.col("cx")) / 2}).where(F.col("mid").between(0.35, 0.65) & (F.col("gap") > 0))
    wide = gaps.groupBy(*PAGE).agg(F.max(F.struct("gap", (-F.col("mid")).alias("m"))).alias("g")).where("g.gap >= 0.08").select(*PAGE, (-F.col("g.m")).alias("boundary"))
    return deep.unionByName(wide)


def otsu(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, threshold: the grey level that parts a histogram (keys, level, n) with the largest variance between the parts; the first of equals."""
    w = Window.partitionBy(*keys)
    so_far = w.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, m = F.col("n").cast("double"), F.col("n") * F.col("level").cast("double")
    rows = histogram.withColumns({"w0": F.sum(n).over(so_far), "s0": F.sum(m).over(so_far), "wt": F.sum(n).over(w), "st": F.sum(m).over(w)})
    w1 = F.col("wt") - F.col("w0")
    split = rows.where((F.col("w0") > 0) & (w1 > 0)).withColumn("v", F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / w1, 2))
    return split.groupBy(*keys).agg(F.max_by("level", F.struct("v", (-F.col("level")).alias("l"))).alias("threshold"))
