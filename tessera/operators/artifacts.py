"""Routing of pages, assembly of a document's result, and review suggestions applied to it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import conservative_edit
from tessera.operators.callouts import drawing_pages, sheet_headers
from tessera.operators.lines import PAGE, column_headers
from tessera.operators.mentions import expand_figures

# Confidences from which a review's suggestions are taken, and the least likeness of a corrected line.
CORRECTION, FIGURE, CALLOUT, LIKENESS, LONGEST = 0.8, 0.7, 0.82, 0.72, 8_000
MIN_NATIVE_WORDS = 15


def routed_pages(pages: DataFrame, native: DataFrame, recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with method, is_drawing, is_sheet; words of the method chosen).

    A page with enough native words is read from them, else from recognised
    words where the page has some. A sheet header in either makes a drawing; a
    column pair in the words chosen makes text; else the words decide.
    """
    n, o = (w.groupBy(*PAGE).agg(F.count("*").alias(c)) for w, c in ((native, "n"), (recognised, "o")))
    method = F.when(F.coalesce("n", F.lit(0)) >= MIN_NATIVE_WORDS, "native").when(F.col("o").isNotNull(), "ocr").otherwise("native")
    p = pages.select(*PAGE).join(n, PAGE, "left").join(o, PAGE, "left").select(*PAGE, method.alias("method"))
    cols = [c for c in native.columns if c in recognised.columns]
    both = native.select(*cols, F.lit("native").alias("method")).unionByName(recognised.select(*cols, F.lit("ocr").alias("method")))
    words = both.join(p, [*PAGE, "method"], "left_semi").drop("method")
    sheet = sheet_headers(native.select(*cols)).unionByName(sheet_headers(recognised.select(*cols))).select(*PAGE, F.lit(True).alias("sheet")).distinct()
    pair = column_headers(words).select(*PAGE, F.lit(True).alias("pair"))
    out = p.join(sheet, PAGE, "left").join(pair, PAGE, "left").join(drawing_pages(p, words), PAGE, "left")
    is_sheet = F.coalesce("sheet", F.lit(False))
    drawing = is_sheet | (F.col("pair").isNull() & F.col("is_drawing"))
    return out.select(*PAGE, "method", drawing.alias("is_drawing"), is_sheet.alias("is_sheet")), words


def quality(pages: DataFrame, entries: DataFrame, figures: DataFrame, numerals: DataFrame, occurrences: DataFrame, callouts: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id and the counters of a result, its mode, warning and disposition.

    pages: PAGE, method, is_drawing; the others are counted per doc_id.
    """
    count = lambda df, **c: df.groupBy("doc_id").agg(*[v.alias(k) for k, v in c.items()])
    every = F.count("*")
    parts = [
        count(entries, entry_count=every, detected_references=F.count_if(F.col("reference_method") == "detected"), interpolated_references=F.count_if(F.col("reference_method") == "interpolated")),
        count(figures, figure_mentions=every), count(numerals, numeral_mentions=every), count(occurrences, figure_occurrences=every, inferred_figures=F.count_if(F.col("method") == "sequence_inferred")),
        count(callouts, callouts=every), count(links, verified_links=F.count_if(F.col("status") == "verified")),
    ]
    text = ~F.col("is_drawing")
    out = pages.groupBy("doc_id").agg(every.alias("page_count"), F.count_if(F.col("method") == "ocr").alias("ocr_pages"), F.count_if(text).alias("_text"))
    names = []
    for p in parts:
        names += p.columns[1:]
        out = out.join(p, "doc_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    warned = (F.col("entry_count") > 0) & (F.col("detected_references") == 0)
    mode = F.when(F.col("ocr_pages") == 0, "native").when(F.col("ocr_pages") == F.col("page_count"), "ocr").otherwise("hybrid")
    disposition = F.when(F.col("entry_count") == 0, "partial").when(warned, "complete_with_warnings").otherwise("complete")
    return out.drop("_text").withColumns({"mode": mode, "unanchored": warned, "disposition": disposition})


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def corrected(entries: DataFrame, corrections: DataFrame, model: Column, keys: Sequence[str] = ("doc_id", "entry_id")) -> DataFrame:
    """entries with the suggested texts that are sure, alike and conservative enough; of several, the last by position."""
    c = corrections.groupBy(*keys).agg(F.max_by(F.struct(F.trim("corrected_text").alias("t"), "confidence"), "position").alias("c"))
    both = entries.join(c, list(keys), "left")
    old = F.coalesce(F.nullif("display_text", F.lit("")), "source_text")
    t = F.col("c.t")
    first = F.coalesce((F.col("c.confidence") >= CORRECTION) & (t != "") & (F.length(t) <= LONGEST) & (t != old) & conservative_edit(old, t), F.lit(False))
    good = both.withColumn("_f", first).withColumn("_g", F.when(F.col("_f"), likeness(old, t) >= LIKENESS).otherwise(F.lit(False)))
    take = lambda new, name: F.when(F.col("_g"), new).otherwise(F.col(name))
    return good.withColumns({
        "display_text": take(t, "display_text"), "alignment_method": take(F.lit("ai_cleanup"), "alignment_method"), "alignment_score": take(F.bround("c.confidence", 4), "alignment_score"), "provider": take(model, "provider"),
    }).drop("c", "_f", "_g")


def suggested_figures(entries: DataFrame, suggestions: DataFrame, keys: Sequence[str] = ("doc_id", "entry_id")) -> DataFrame:
    """Figure mentions of sure suggestions whose phrase stands in the line, with the ids that the phrase itself names."""
    raw = F.trim("raw_text")
    both = suggestions.where(F.col("confidence") >= FIGURE).join(entries.select(*keys, "display_text"), list(keys))
    at = F.expr("locate(lower(trim(raw_text)), lower(display_text))")
    expr = F.regexp_extract(raw, r"(?i)^(?:FIGS?|FIGURES?)\s*\.?\s*(.+)$", 1)
    rows = both.withColumns({"start": at - 1, "raw_text": raw, "figure_ids": expand_figures(expr)}).where("start >= 0 and raw_text <> ''")
    return rows.withColumn("end", F.col("start") + F.length("raw_text")).where(F.size("figure_ids") > 0).select(*keys, "start", "end", "raw_text", "figure_ids")


def suggested_numerals(entries: DataFrame, suggestions: DataFrame, keys: Sequence[str] = ("doc_id", "entry_id")) -> DataFrame:
    """Numeral mentions of sure suggestions whose value stands by itself in the line, at its first place."""
    value = F.upper(F.trim("value"))
    both = suggestions.where(F.col("confidence") >= CALLOUT).select(*keys, value.alias("value"), F.nullif(F.trim("component_label"), F.lit("")).alias("label")).where(F.col("value").rlike("^[0-9]{2,4}[A-Z]?$"))
    rows = both.join(entries.select(*keys, "display_text"), list(keys))
    ahead = F.expr("split(display_text, concat('(?<![A-Za-z0-9])', value, '(?![A-Za-z0-9])'), 2)")
    return rows.withColumn("_p", ahead).where(F.size("_p") > 1).withColumn("start", F.length(F.get("_p", F.lit(0)))).withColumn("end", F.col("start") + F.length("value")).select(*keys, "value", "label", "start", "end")
