"""Geometry of normalised boxes as column expressions. A box is a struct of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """0 for boxes apart or without area."""
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / F.when(union > 0, union)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """The overlap as a part of the smaller box."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, overlap(a, b) / F.when(small > 0, small)).otherwise(0.0)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def center_distance(a: Column, b: Column) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def clamped(b: Column, least: float = 1e-4) -> Column:
    """Into the unit square, with an extent of at least `least`."""
    x0, y0, x1, y1 = (unit(b[n]) for n in ("x0", "y0", "x1", "y1"))
    return box(x0, y0, F.when(x1 <= x0, F.least(F.lit(1.0), x0 + least)).otherwise(x1), F.when(y1 <= y0, F.least(F.lit(1.0), y0 + least)).otherwise(y1))


def is_valid(b: Column) -> Column:
    return F.coalesce((b["x0"] >= 0) & (b["x0"] < b["x1"]) & (b["x1"] <= 1) & (b["y0"] >= 0) & (b["y0"] < b["y1"]) & (b["y1"] <= 1), F.lit(False))


def safe(b: Column) -> Column:
    """A box given in thousandths or in units, clamped; null if nothing is left."""
    top = F.greatest(*[F.abs(b[n]) for n in ("x0", "y0", "x1", "y1")])
    k = F.when(top > 1, F.lit(1000.0)).otherwise(F.lit(1.0))
    x0, y0, x1, y1 = (unit(b[n] / k) for n in ("x0", "y0", "x1", "y1"))
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def unrotated(b: Column, quarter_turns: Column) -> Column:
    """A box seen on a page turned clockwise by quarter turns, on the page as it was."""
    q = F.pmod(quarter_turns, F.lit(4))
    return (
        F.when(q == 1, box(b["y0"], 1 - b["x1"], b["y1"], 1 - b["x0"]))
        .when(q == 2, box(1 - b["x1"], 1 - b["y1"], 1 - b["x0"], 1 - b["y0"]))
        .when(q == 3, box(1 - b["y1"], b["x0"], 1 - b["y0"], b["x1"]))
        .otherwise(box(b["x0"], b["y0"], b["x1"], b["y1"]))
    )


def from_crop(b: Column, crop: Column) -> Column:
    """A box in a crop's own unit square, on the page."""
    w, h = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    return box(crop["x0"] + b["x0"] * w, crop["y0"] + b["y0"] * h, crop["x0"] + b["x1"] * w, crop["y0"] + b["y1"] * h)


def indent_level(offset: Column, height: Column) -> Column:
    """0 below 0.55 of the indent unit, else the half-even rounded number of units, 1 to 6."""
    unit_width = F.greatest(F.lit(0.008), height * 0.65)
    return F.when(offset < unit_width * 0.55, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(6), F.bround(offset / unit_width).cast("int"))))


def candidate_score(mean: Column, characters: Column, low: Column) -> Column:
    return mean + 4 * F.log1p(characters) - 25 * low
