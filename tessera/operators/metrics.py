"""Accuracy metrics, gates and threshold sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import iou
from tessera.operators.records import last_labels
from tessera.operators.rounds import taken_in_turn

# Gate thresholds; the sense tells whether the value must reach or stay under it.
GATES = [
    ("reference_exact", 0.985, ">="),
    ("reference_within_one", 0.995, ">="),
    ("callout_precision", 0.98, ">="),
    ("callout_recall", 0.95, ">="),
    ("association_precision", 0.99, ">="),
    ("silent_verified_on_ambiguous", 0.0, "<="),
    ("substitution_rejection", 1.0, ">="),
    ("median_box_iou", 0.85, ">="),
]


def pooled(num: Column, den: Column) -> Column:
    """The ratio of sums, null over nothing; not the mean of ratios."""
    return F.sum(num) / F.nullif(F.sum(den), F.lit(0))


def reference_score(labels: DataFrame, entries: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: labels, exact ones and those within one line; a wrong column or a missing entry is a miss.

    labels: keys, ordinal, column, line; entries: the same. Of several labels of an ordinal the last by position counts, where labels have one.
    """
    if "position" in labels.columns:
        labels = last_labels(labels, [*keys, "ordinal"], "position")
    got = entries.select(*keys, "ordinal", F.col("column").alias("got_column"), F.col("line").alias("got_line"))
    both = labels.join(got, [*keys, "ordinal"], "left")
    same = F.coalesce(F.col("column").eqNullSafe(F.col("got_column")), F.lit(False)) & F.col("got_line").isNotNull()
    off = F.abs(F.col("line") - F.col("got_line"))
    return both.groupBy(*keys).agg(F.count("line").alias("den"), F.count_if(same & (off == 0)).alias("exact"), F.count_if(same & (off <= 1)).alias("within_one"))


def greedy_matches(labels: DataFrame, detected: DataFrame, keys: Sequence[str] = ("doc_id",), least: float = 0.3) -> DataFrame:
    """keys, label_ix, detected_ix, iou: each label in order takes the free detection of its value and page with
    the largest overlap of at least `least`; of equal ones the last.

    Pairs are made by an equal join and chosen in rounds.
    """
    a = labels.select(*keys, "value", "page_index", F.col("ix").alias("label_ix"), F.col("box").alias("a"))
    b = detected.select(*keys, "value", "page_index", F.col("ix").alias("detected_ix"), F.col("box").alias("b"))
    pairs = a.join(b, [*keys, "value", "page_index"]).withColumn("iou", iou(F.col("a"), F.col("b"))).where(F.col("iou") >= least).select(*keys, "label_ix", "detected_ix", "iou")
    return taken_in_turn(pairs, keys, "label_ix", "detected_ix", "iou")


def callout_score(labels: DataFrame, detected: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: matches, labels, detections, and the list of overlaps of the matches."""
    m = greedy_matches(labels, detected, keys).groupBy(*keys).agg(F.count("*").alias("matched"), F.sort_array(F.collect_list("iou")).alias("ious"))
    n = labels.groupBy(*keys).agg(F.count("*").alias("labels"))
    d = detected.groupBy(*keys).agg(F.count("*").alias("detected"))
    out = n.join(d, list(keys), "full").join(m, list(keys), "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "labels", "detected")], F.coalesce("ious", F.array().cast("array<double>")).alias("ious"))


def association_score(labels: DataFrame, found: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: verified associations that a label confirms, all verified ones, and ambiguous labels reported verified."""
    k = [*keys, "entry_ordinal", "value"]
    verified = found.where("status = 'verified'").select(*k).distinct()
    good = labels.where("status = 'verified'").select(*k).distinct()
    unsure = labels.where("status = 'ambiguous'").select(*k).distinct()
    den = verified.groupBy(*keys).agg(F.count("*").alias("den"))
    num = verified.join(good, k, "left_semi").groupBy(*keys).agg(F.count("*").alias("num"))
    bad = unsure.join(verified, k, "left_semi").groupBy(*keys).agg(F.count("*").alias("silent"))
    out = den.join(num, list(keys), "left").join(bad, list(keys), "left")
    return out.select(*keys, F.coalesce("num", F.lit(0)).alias("num"), "den", F.coalesce("silent", F.lit(0)).alias("silent"))


def substitution_rejection(entries: DataFrame, wrong: Column) -> DataFrame:
    """Of the lines of documents with the wrong text, how many kept their own; 0 of 0 for other documents."""
    kept = F.col("alignment_method").isin("unmatched") | F.col("alignment_method").isNull()
    return entries.groupBy("doc_id").agg(F.count_if(wrong & kept).alias("num"), F.count_if(wrong).alias("den"))


def gates(values: DataFrame) -> DataFrame:
    """name, value, threshold, applicable, passed of metrics(name, value); a gate without a value is passed but not applicable."""
    spark = values.sparkSession
    limits = spark.createDataFrame(GATES, "name string, threshold double, sense string")
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(v.isNull(), True).when(F.col("sense") == ">=", v >= t).otherwise(v <= t)
    return limits.join(values, "name", "left").select("name", "value", "threshold", v.isNotNull().alias("applicable"), ok.alias("passed"))


def sweep(lines: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """min_ratio, coverage, rejection. lines: ratio, right (whether the text is the line's own)."""
    t = lines.sparkSession.createDataFrame([(float(x),) for x in thresholds], "min_ratio double")
    taken = F.col("ratio") >= F.col("min_ratio")
    each = lines.crossJoin(F.broadcast(t)).groupBy("min_ratio")  # a stated list of thresholds
    return each.agg(
        (F.count_if(taken & F.col("right")) / F.nullif(F.count_if("right"), F.lit(0))).alias("coverage"),
        (F.count_if(~taken & ~F.col("right")) / F.nullif(F.count_if(~F.col("right")), F.lit(0))).alias("rejection"),
    )


def recommended(points: DataFrame) -> DataFrame:
    """The least threshold that rejects everything wrong, else null."""
    return points.agg(F.min(F.when(F.col("rejection") >= 1.0, F.col("min_ratio"))).alias("min_ratio"))


def ocr_quality(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per page: words, mean confidence (each 0 to 100), part of low ones (< 50), useful characters."""
    c = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(100.0))
    n = F.count("confidence")
    return words.groupBy(*keys).agg(
        F.count("*").alias("n_words"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.count_if(c < 50) / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("low"),
        F.coalesce(F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))), F.lit(0)).alias("useful"),
    )


def report(points: DataFrame, columns: Sequence[str]) -> Iterator[str]:
    """Lines of a text table; points is a small result (one row a metric or threshold)."""
    rows = [[("-" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c])) for c in columns] for r in points.select(*columns).collect()]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(columns)]
    yield "  ".join(c.ljust(w) for c, w in zip(columns, widths))
    for r in rows:
        yield "  ".join(c.ljust(w) for c, w in zip(r, widths))
