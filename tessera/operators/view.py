"""What a viewer asks of a document: hits within lines, highlights, the line at a point, thinned strokes, rotation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import box

WHOLE_LINE = (1 << 53) - 1


def segments(text: Column, query: str) -> Column:
    """array of (text, hit): the parts of a text in order, hits of a query in any case among them; a blank query hits nothing."""
    q = query.strip()
    if not q:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    pattern = "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", q)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("b"))
    both = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(p["a"].alias("text"), F.lit(False).alias("hit")), F.struct(p["b"].alias("text"), F.lit(True).alias("hit")))))
    return F.filter(both, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def highlight_ranges(annotations: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, entry_id, start, end, color, opacity of highlights: their text ranges, or whole lines of those that only list entries."""
    v = F.try_parse_json("geometry")
    rows = annotations.where("kind = 'highlight'").select(*keys, F.coalesce("color", F.lit("#ffe066")).alias("color"), v.alias("v"))
    rows = rows.withColumn("opacity", F.coalesce(F.try_variant_get("v", "$.opacity", "double"), F.lit(0.52)))
    ranges, ids = F.try_variant_get("v", "$.text_ranges", "array<variant>"), F.try_variant_get("v", "$.entry_ids", "array<variant>")
    text = lambda x, p: F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")) == "STRING", F.try_variant_get(x, p, "string"))
    number = lambda x, p: F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x, p, "bigint"))
    new = F.transform(ranges, lambda r: F.struct(text(r, "$.entry_id").alias("entry_id"), number(r, "$.start").alias("start"), number(r, "$.end").alias("end")))
    old = F.transform(ids, lambda r: F.struct(text(r, "$").alias("entry_id"), F.lit(0).cast("long").alias("start"), F.lit(WHOLE_LINE).alias("end")))
    out = rows.select(*keys, "color", "opacity", F.explode(F.when(ranges.isNotNull(), new).otherwise(old)).alias("r")).select(*keys, "r.*", "color", "opacity")
    return out.where("entry_id is not null and start is not null and end is not null")


def line_at(points: DataFrame, lines: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), reach: float = 0.05) -> DataFrame:
    """points with the line of the page whose box is nearest, at most reach away; the first of equals.

    A point meets only the lines that reach its band of the page.
    """
    band = lambda y: F.floor(y / max(reach, 0.02))
    b = F.col("box")
    dx = F.greatest(b["x0"] - F.col("x"), F.col("x") - b["x1"], F.lit(0.0))
    dy = F.greatest(b["y0"] - F.col("y"), F.col("y") - b["y1"], F.lit(0.0))
    banded = lines.where(b["y1"] >= b["y0"]).select(*keys, "entry_id", "ordinal", "box", F.explode(F.sequence(band(b["y0"] - reach - 1e-9), band(b["y1"] + reach + 1e-9))).alias("_band"))
    near = points.withColumn("_band", band(F.col("y"))).join(banded, [*keys, "_band"]).withColumn("d", F.hypot(dx, dy)).where(F.col("d") <= reach)
    best = near.groupBy(*keys, "point_id").agg(F.min_by("entry_id", F.struct("d", "ordinal")).alias("entry_id"))
    return points.join(best, [*keys, "point_id"], "left")


def thinned(points: Column, least: float = 0.0015) -> Column:
    """A stroke's points but those nearer than least to the last one kept; both ends stay."""
    n = F.size(points)
    first, last = F.slice(points, 1, 1), F.slice(points, F.greatest(n, F.lit(1)), F.lit(1))
    inner = F.slice(points, F.lit(2), F.greatest(n - 2, F.lit(0)))

    def step(acc, p):
        before = F.element_at(acc, F.lit(-1))
        return F.when(F.hypot(p["x"] - before["x"], p["y"] - before["y"]) >= least, F.concat(acc, F.array(p))).otherwise(acc)

    return F.when(n <= 2, points).otherwise(F.concat(F.aggregate(inner, first, step), last))


def rotated(b: Column, quarter_turns: Column) -> Column:
    """A page's box as seen after clockwise quarter turns; geometry.unrotated takes it back."""
    q = F.pmod(quarter_turns, F.lit(4))
    return (
        F.when(q == 1, box(1 - b["y1"], b["x0"], 1 - b["y0"], b["x1"]))
        .when(q == 2, box(1 - b["x1"], 1 - b["y1"], 1 - b["x0"], 1 - b["y0"]))
        .when(q == 3, box(b["y0"], 1 - b["x1"], b["y1"], 1 - b["x0"]))
        .otherwise(box(b["x0"], b["y0"], b["x1"], b["y1"]))
    )


def span_box(b: Column, start: Column, end: Column, length: Column) -> Column:
    """The part of a line's box that characters start to end take, as if all were equally wide; a tenth of the height, 0.003 at most, is left out above and below."""
    n = F.greatest(length, F.lit(1))
    inset = F.least((b["y1"] - b["y0"]) * 0.1, F.lit(0.003))
    w = b["x1"] - b["x0"]
    return box(b["x0"] + w * F.least(start, n) / n, b["y0"] + inset, b["x0"] + w * F.least(end, n) / n, b["y1"] - inset)
