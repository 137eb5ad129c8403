"""Choices that go by an order, in rounds over a table of pairs: who cannot be forestalled any more decides, the rest wait.

The result is that of going through the order one by one; a round settles all
that is settled by then, wherever it is, so no group is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import center_distance, iou
from tessera.store import stored


def taken_in_turn(pairs: DataFrame, keys: Sequence[str], taker: str, thing: str, worth: str) -> DataFrame:
    """The pairs in which each taker, in order, has the free thing of the largest worth to it; of equal ones the last.

    A pair stands as soon as the thing is its taker's best and no earlier taker of the
    thing is left. pairs holds each pair once; empty, it gives none.
    """
    left, out = stored(pairs, "pairs"), pairs.limit(0)
    best = Window.partitionBy(*keys, taker).orderBy(F.desc(worth), F.desc(thing))
    first = Window.partitionBy(*keys, thing).orderBy(taker)
    while left.limit(1).count():
        marked = left.withColumn("_b", F.row_number().over(best)).withColumn("_f", F.row_number().over(first))
        won = stored(marked.where("_b = 1 and _f = 1").drop("_b", "_f"), "won")
        out = out.unionByName(won)
        left = stored(left.join(won.select(*keys, taker), [*keys, taker], "left_anti").join(won.select(*keys, thing), [*keys, thing], "left_anti").select(left.columns), "pairs")
    return out


def dropped_in_turn(conflicts: DataFrame, keys: Sequence[str], better: str = "better", worse: str = "worse") -> DataFrame:
    """keys, id: what goes when, from the best down, each one is kept unless it conflicts with one that was kept.

    conflicts holds a row a pair. One that is never the worse of an open conflict is kept, and
    drops what it conflicts with; their other conflicts then fall away.
    """
    left, out = stored(conflicts.select(*keys, better, worse), "conflicts"), conflicts.select(*keys, F.col(worse).alias("id")).limit(0)
    while left.limit(1).count():
        lesser = left.select(*keys, F.col(worse).alias(better)).distinct()
        drop = stored(left.join(lesser, [*keys, better], "left_anti").select(*keys, F.col(worse).alias("id")).distinct(), "dropped")
        out = out.unionByName(drop)
        for side in (better, worse):
            left = left.join(drop.withColumnRenamed("id", side), [*keys, side], "left_anti")
        left = stored(left.select(*keys, better, worse), "conflicts")
    return out


def near_pairs(boxes: DataFrame, keys: Sequence[str], row_id: str, box: str = "box", margin: float = 0.0, cell: float = 0.05, also: Column | None = None) -> DataFrame:
    """keys, a, b, box_a, box_b (and also_a, also_b): pairs (a < b) of a key whose boxes, margin wider on all sides, overlap or touch.

    Boxes are put into the cells of a grid that they reach; a pair is made only in the cell where its overlap begins.
    """
    b = F.col(box)
    low = {n: F.floor((b[n] - margin) / cell) for n in ("x0", "y0")}
    high = {n: F.floor((b[n] + margin) / cell) for n in ("x1", "y1")}
    rows = boxes.where(b["x1"] + margin >= b["x0"] - margin).where(b["y1"] + margin >= b["y0"] - margin)
    rows = rows.select(*keys, F.col(row_id).alias("_i"), b.alias("_b"), *([] if also is None else [also.alias("_also")]), low["x0"].alias("_x"), low["y0"].alias("_y"), F.explode(F.sequence(low["x0"], high["x1"])).alias("_cx"), high["y1"].alias("_h"))
    rows = rows.select("*", F.explode(F.sequence("_y", "_h")).alias("_cy"))
    one, two = (rows.select(*keys, "_cx", "_cy", F.col("_i").alias(s), F.col("_b").alias(f"box_{s}"), *([] if also is None else [F.col("_also").alias(f"also_{s}")]), F.col("_x").alias(f"_x{s}"), F.col("_y").alias(f"_y{s}")) for s in "ab")
    both = one.join(two, [*keys, "_cx", "_cy"]).where((F.col("a") < F.col("b")) & (F.col("_cx") == F.greatest("_xa", "_xb")) & (F.col("_cy") == F.greatest("_ya", "_yb")))
    p, q = F.col("box_a"), F.col("box_b")
    meet = (p["x0"] - margin <= q["x1"] + margin) & (q["x0"] - margin <= p["x1"] + margin) & (p["y0"] - margin <= q["y1"] + margin) & (q["y0"] - margin <= p["y1"] + margin)
    return both.where(meet).select(*keys, "a", "b", "box_a", "box_b", *([] if also is None else ["also_a", "also_b"]))


def one_a_spot(rows: DataFrame, keys: Sequence[str], row_id: str, order: Sequence[Column], least: float = 0.25, reach: float = 0.008) -> DataFrame:
    """rows less those on the spot of a better one that stays: boxes overlap by least, or centres are at most reach apart.

    order: expressions of which the smallest, compared in turn, is the best; it ends with row_id.
    """
    pairs = near_pairs(rows, keys, row_id, margin=reach / 2 + 1e-4, also=F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    pairs = stored(pairs, "near")  # few; compared within the join, they make its code too large to be compiled
    same = pairs.where((iou(F.col("box_a"), F.col("box_b")) >= least) | (center_distance(F.col("box_a"), F.col("box_b")) <= reach))
    ahead = F.col("also_a") < F.col("also_b")
    gone = dropped_in_turn(same.select(*keys, F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("worse")), keys)
    return rows.join(gone.withColumnRenamed("id", row_id), [*keys, row_id], "left_anti").select(rows.columns)


def nearest(points: DataFrame, places: DataFrame, keys: Sequence[str], point_id: str, most: int = 14) -> DataFrame:
    """keys, point_id, place, distance: the nearest of the places of the same keys, of equal ones the first by position.

    points: x, y; places: x, y, place, position. Each key has a grid of about one place a
    cell; a point looks at the nine cells around it, and if a nearer place may lie outside them, again on a
    grid of twice the cell, to one cell for all at last. Places that stand on one spot are one. Points without a place are left out.
    """
    spots = places.groupBy(*keys, "x", "y").agg(F.min_by("place", "position").alias("place"), F.min("position").alias("position"))
    edge = spots.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("_w"))
    edge = stored(edge.withColumn("_k", F.least(F.lit(most), F.floor(F.log2(F.sqrt("_n")))).cast("int")), "edges")
    spots = stored(spots.join(edge, list(keys)), "spots")
    open_points = stored(points.join(edge, list(keys)).select(*keys, point_id, "x", "y", "_x0", "_y0", "_w", "_k"), "points")
    found, step = None, 0
    while True:
        k = F.greatest(F.lit(0), F.col("_k") - step)
        side = F.col("_w") / F.pow(F.lit(2.0), k)
        at = lambda v, low: F.floor((F.col(v) - F.col(low)) / side)
        last = k == 0
        cell = lambda v, low: F.when(last, F.lit(0).cast("long")).otherwise(at(v, low))
        there = spots.select(*keys, cell("x", "_x0").alias("_cx"), cell("y", "_y0").alias("_cy"), F.col("x").alias("_px"), F.col("y").alias("_py"), "place", "position")
        around = F.when(last, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
        rows = open_points.select("*", cell("x", "_x0").alias("_ox"), cell("y", "_y0").alias("_oy"), side.alias("_s"), last.alias("_last"), F.explode(around).alias("_dx"), around.alias("_a"))
        rows = rows.select("*", F.explode("_a").alias("_dy")).withColumns({"_cx": F.col("_ox") + F.col("_dx"), "_cy": F.col("_oy") + F.col("_dy")})
        dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
        d = F.sqrt(dx * dx + dy * dy)  # hypot rounds otherwise, so that it parts places that are equally far, or joins others
        border = F.col("_s") + F.least(F.col("x") - F.col("_x0") - F.col("_ox") * F.col("_s"), (F.col("_ox") + 1) * F.col("_s") + F.col("_x0") - F.col("x"), F.col("y") - F.col("_y0") - F.col("_oy") * F.col("_s"), (F.col("_oy") + 1) * F.col("_s") + F.col("_y0") - F.col("y"))
        best = rows.join(there, [*keys, "_cx", "_cy"]).withColumn("_d", d).groupBy(*keys, point_id).agg(
            F.min(F.struct(F.col("_d").alias("distance"), "position", "place")).alias("m"), F.min(border).alias("_border"), F.first("_last").alias("_last")
        )
        sure = stored(best.where(F.col("_last") | (F.col("m.distance") < F.col("_border") - 1e-12)).select(*keys, point_id, "m.place", "m.distance"), "sure")
        found = sure if found is None else found.unionByName(sure)
        open_points = stored(open_points.join(sure.select(*keys, point_id), [*keys, point_id], "left_anti").select(open_points.columns), "points")
        if not open_points.limit(1).count():
            return found
        step += 1


def exact_median(df: DataFrame, keys: Sequence[str], value: str, bins: int = 1024) -> DataFrame:
    """keys, median of the finite values of each key, exactly: the middle ones are closed in by counting ranges.

    Equal values are counted once and written; a round counts them in bins of the range that is left, and goes on
    with the range of the bin that holds the middle. No task holds a key's values.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf"))))
    rows = stored(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_m")), "values")
    whole = rows.groupBy(*keys).agg(F.sum("_m").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("t"), F.expr("(_n - 1) div 2").alias("r")), F.struct(F.lit(1).alias("t"), F.expr("_n div 2").alias("r"))))
    goal = stored(whole.select(*keys, "_lo", "_hi", sides.alias("_g")).select(*keys, F.col("_g.t").alias("_t"), F.col("_g.r").alias("_r"), "_lo", "_hi"), "middle")
    done = goal.where("_lo = _hi")
    goal = goal.where("_lo < _hi")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    while goal.limit(1).count():
        named = goal.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        some = rows.join(named, same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        place = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
        each = some.groupBy(*keys, "_t", "_r", place.alias("_p")).agg(F.sum("_m").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_t").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = each.withColumn("_c", upto).where((F.col("_r") < F.col("_c")) & (F.col("_r") >= F.col("_c") - F.col("_n")))
        goal = stored(held.select(*keys, "_t", (F.col("_r") - F.col("_c") + F.col("_n")).alias("_r"), "_lo", "_hi"), "middle")
        done = done.unionByName(goal.where("_lo = _hi"))
        goal = goal.where("_lo < _hi")
    return done.groupBy(*keys).agg(F.avg("_lo").alias("median"))
