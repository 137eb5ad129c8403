"""From positioned words to lines, and from lines to cited entries.

Words: doc_id, page_index, word_ix, text, x0, y0, x1, y1, confidence. A page's
words are grouped in one pass over them in reading order, because a line's tolerance
is around the mean of the words it has so far; all else are joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType, _parse_datatype_string

from tessera.functions.geometry import box, clamped, indent_level
from tessera.functions.text import gutter_value, ocr_digits, paragraph_marker, without_marker
from tessera.store import stored

PAGE = ["doc_id", "page_index"]
# Fixed value: how far a word may be from its line's mean, as a part of the median height.
RATIO = 0.6
# Vertical zones, the centre strip and tolerances, as parts of the page.
TOP_ZONE, ROW_TOLERANCE, HEADER_PAD, CONTENT_TOP, CONTENT_BOTTOM = 0.14, 0.01, 0.012, 0.06, 0.95
GUTTER_HALF_WIDTH, GUTTER_SPREAD, LINES_PER_COLUMN = 0.07, 0.012, 65


def line_numbers(cy: np.ndarray, x0: np.ndarray, heights: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """The line of each word: a word further than ratio of the median height from the mean of the line so far starts a new one."""
    high = heights[heights > 0]
    reach = max((np.median(high) if len(high) else 0.01) * ratio, 1e-4)
    out, lines = np.zeros(len(cy), int), Lines()
    order = np.lexsort((x0, cy))
    out[order] = [lines.add(y, reach, i == 0) for i, y in enumerate(cy[order].tolist())]
    return out


class Lines:
    """Numbers words that come in reading order, page after page."""

    def __init__(self) -> None:
        self.line, self.total, self.n = 0, 0.0, 0

    def add(self, cy: float, reach: float, new_page: bool) -> int:
        if new_page:
            self.line, self.total, self.n = 0, 0.0, 0
        elif abs(cy - self.total / self.n) > reach:
            self.line, self.total, self.n = self.line + 1, 0.0, 0
        self.total += cy
        self.n += 1
        return self.line


def grouped_lines(words: DataFrame, keys: Sequence[str] = tuple(PAGE)) -> DataFrame:
    """words with line_ix from the top of each group of keys.

    A window brings each page's words together in reading order; one pass over
    a partition then numbers them, however small its pages are.
    """
    cy, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    page = Window.partitionBy(*keys)
    reach = F.greatest(F.coalesce(F.median(F.when(height > 0, height)).over(page), F.lit(0.01)) * RATIO, F.lit(1e-4))
    order = ["_cy", "x0", "word_ix"]
    rows = words.withColumns({"_cy": cy, "_reach": reach}).withColumn("_first", F.row_number().over(page.orderBy(*order)) == 1)
    rows = rows.sortWithinPartitions(*keys, *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines()
        for b in batches:
            own = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_cy", "_reach", "_first")]
            line = pa.array([lines.add(*x) for x in zip(*own)], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(b.columns) - 3], line], [*b.schema.names[:-3], "line_ix"])

    return rows.mapInArrow(number, StructType([*words.schema, StructField("line_ix", IntegerType())]))


def line_text(words: DataFrame, keys: Sequence[str], tabs: bool = False) -> DataFrame:
    """One row a line: text, cy, box, height, confidence, n_words. With tabs, wide gaps are one to four tabs."""
    rows, sep = words, F.lit(" ")
    if tabs:
        width = F.when((F.col("x1") > F.col("x0")) & (F.trim("text") != ""), (F.col("x1") - F.col("x0")) / F.length(F.trim("text")))
        line = Window.partitionBy(*keys)
        order = line.orderBy("x0", "word_ix")
        rows = words.withColumn("_cw", F.coalesce(F.median(width).over(line), F.lit(0.0))).withColumn("_gap", F.greatest(F.lit(0.0), F.col("x0") - F.lag("x1").over(order)))
        wide = (F.col("_cw") > 0) & (F.col("_gap") >= F.greatest(F.lit(0.012), F.col("_cw") * 2.75))
        n = F.greatest(F.lit(1), F.least(F.lit(4), F.bround(F.col("_gap") / F.greatest(F.col("_cw") * 4, F.lit(0.018))).cast("int")))
        sep = F.when(F.col("_gap").isNull(), "").when(wide, F.repeat(F.lit("\t"), n)).otherwise(" ")
    piece = F.struct("x0", "word_ix", F.concat(sep, F.col("text")).alias("t"))
    return rows.groupBy(*keys).agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "")).alias("text"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        clamped(box(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"))).alias("box"), F.min("x0").alias("left"), F.coalesce(F.median(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))), F.lit(0.012)).alias("height"),
        F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"),
    )


def entry_id(ordinal: Column) -> Column:
    return F.format_string("line_%07d", ordinal)


def application_entries(words: DataFrame, method: str = "native", top: float = CONTENT_TOP, bottom: float = CONTENT_BOTTOM) -> DataFrame:
    """Entries of applications: each line with the paragraph whose marker came last, over pages."""
    cy = (F.col("y0") + F.col("y1")) / 2
    lines = line_text(grouped_lines(words.where(cy.between(top, bottom))), [*PAGE, "line_ix"], tabs=method == "ocr").where("text <> ''")
    lines = lines.withColumn("common_left", F.median("left").over(Window.partitionBy(*PAGE))).withColumn("marker", paragraph_marker(F.col("text")))
    doc = Window.partitionBy("doc_id").orderBy("page_index", "cy", "line_ix")
    so_far = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("marker", ignorenulls=True).over(so_far)
    rows = lines.withColumn("paragraph", F.coalesce(carried, F.lit("0000"))).withColumn("seen", carried.isNotNull()).withColumn("body", F.when(F.col("marker").isNotNull(), without_marker(F.col("text"))).otherwise(F.col("text")))
    rows = rows.where("body <> ''").withColumn("ordinal", F.row_number().over(doc) - 1)
    found = F.col("marker").isNotNull()
    return rows.select(
        "doc_id", "page_index", "ordinal", entry_id(F.col("ordinal")).alias("entry_id"), "paragraph", "box", F.col("body").alias("source_text"), F.col("body").alias("display_text"), "confidence",
        F.when(found, "detected").when(F.col("seen"), "interpolated").otherwise("none").alias("reference_method"), F.when(found, "high").when(F.col("seen"), "medium").otherwise("low").alias("reference_confidence"),
        found.alias("paragraph_start"), indent_level(F.col("left") - F.col("common_left"), F.col("height")).alias("indent_level"),
    )


def count_markers(words: DataFrame) -> DataFrame:
    """doc_id, n_markers, doc_type: an application from three marker words on."""
    n = F.count_if(F.trim("text").rlike(r"^[\[(][0-9]{3,4}[\])]$"))
    return words.groupBy("doc_id").agg(n.alias("n_markers")).withColumn("doc_type", F.when(F.col("n_markers") >= 3, "application").otherwise("grant"))


def column_headers(words: DataFrame) -> DataFrame:
    """PAGE, left_column, right_column, header_y: a number and its successor left and right of the centre on one row at the top.

    Rows with a country or kind code are none.
    """
    cy, cx = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    top = words.withColumns({"cy": cy, "cx": cx}).where(F.col("cy") < TOP_ZONE)
    kinds = top.where(F.trim("text").isin("US", "A1", "A2", "B1", "B2")).groupBy(*PAGE).agg(F.collect_set("cy").alias("kinds"))
    numbers = top.withColumn("n", ocr_digits(F.col("text")).cast("int")).where("n is not null").join(kinds, PAGE, "left")
    numbers = numbers.where(~F.coalesce(F.exists("kinds", lambda k: F.abs(k - F.col("cy")) <= ROW_TOLERANCE), F.lit(False)))
    left = numbers.where("cx < 0.5").select(*PAGE, F.col("n").alias("l"), F.col("cy").alias("ly"), F.col("word_ix").alias("lw"))
    right = numbers.where("cx >= 0.5").select(*PAGE, (F.col("n") - 1).alias("l"), F.col("cy").alias("ry"), F.col("word_ix").alias("rw"))
    pairs = left.join(right, [*PAGE, "l"]).where(F.abs(F.col("ly") - F.col("ry")) <= ROW_TOLERANCE)
    best = F.min(F.struct(F.greatest("ly", "ry").alias("y"), "lw", "rw", "l"))
    return pairs.groupBy(*PAGE).agg(best.alias("b")).select(*PAGE, F.col("b.l").alias("left_column"), (F.col("b.l") + 1).alias("right_column"), F.col("b.y").alias("header_y"))


def running_header(words: DataFrame) -> DataFrame:
    """PAGE, running_y: the lowest row at the top with a country code and an identifier."""
    cy = (F.col("y0") + F.col("y1")) / 2
    t, top = F.upper(F.trim("text")), words.where(cy < TOP_ZONE)
    us = t.rlike("^US$|^US[0-9]")
    rows = grouped_lines(top.join(top.where(us).select(*PAGE).distinct(), PAGE, "left_semi"))  # other pages have no such row
    per = rows.groupBy(*PAGE, "line_ix").agg(F.bool_or(us).alias("us"), F.bool_or(t.rlike("[0-9]") | t.isin("A1", "A2", "B1", "B2")).alias("id"), F.avg(cy).alias("cy"))
    return per.where("us and id").groupBy(*PAGE).agg(F.max("cy").alias("running_y"))


def gutter_numbers(words: DataFrame, headers: DataFrame) -> DataFrame:
    """Printed line numbers of the centre strip below the header, without those off the strip's own median."""
    rows = words.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "cx": (F.col("x0") + F.col("x1")) / 2}).where(F.abs(F.col("cx") - 0.5) < GUTTER_HALF_WIDTH)
    rows = stored(rows.withColumn("n", gutter_value(F.col("text"))).where("n is not null"), "strip")
    rows = rows.join(headers.select(*PAGE, "header_y"), PAGE).where(F.col("cy") > F.col("header_y") + HEADER_PAD)
    w = Window.partitionBy(*PAGE)
    rows = rows.withColumns({"_m": F.median("cx").over(w), "_c": F.count("*").over(w)})
    return rows.where((F.col("_c") < 3) | (F.abs(F.col("cx") - F.col("_m")) <= GUTTER_SPREAD)).drop("_m", "_c")


def progression(pairs: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """Of markers from top to bottom those that rise by one to three of the commonest step."""
    pairs = sorted(pairs, key=lambda p: p[0])
    rises = [b[1] - a[1] for a, b in zip(pairs, pairs[1:]) if b[1] > a[1]]
    step = max(dict.fromkeys(rises), key=rises.count) if rises else 5
    out = pairs[:1]
    for y, n in pairs[1:]:
        up = n - out[-1][1]
        if y > out[-1][0] and up > 0 and up % step == 0 and up // step <= 3:
            out.append((y, n))
    return out


def printed_lines(ys: np.ndarray, ns: np.ndarray, size: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The line at each height, by the row of anchors beside it (size of them, in order, then infinity): linear between the anchors around it and beyond the outer ones, half-even, at least 1."""
    row = np.arange(len(y))
    i = np.clip((ys < y[:, None]).sum(1) - 1, 0, size - 2)
    y0, n0 = ys[row, i], ns[row, i]
    dy = ys[row, i + 1] - y0
    return np.maximum(1, np.where(dy == 0, n0, np.rint(n0 + (y - y0) / np.where(dy == 0, 1.0, dy) * (ns[row, i + 1] - n0)))).astype(np.int64)


def printed_line(anchors: list[tuple[float, int]], y: float) -> int:
    """The line at a height by a page's anchors; that of a single anchor, or 1."""
    if len(anchors) < 2:
        return max(1, anchors[0][1]) if anchors else 1
    ys, ns = (np.array([x], float) for x in zip(*anchors))
    return int(printed_lines(ys, ns, np.array([len(anchors)]), np.array([y]))[0])


def interpolated(rows: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows (keys, y) with the printed line of their height, by windows alone: the anchors around a row are the last at or
    before it and the next one; outside, the two nearest the end."""
    whole = Window.partitionBy(*keys)
    a = anchors.select(*keys, "y", "n", F.lit(True).alias("_a"), F.row_number().over(whole.orderBy("y", "n")).alias("_i"), F.count("*").over(whole).alias("_c"))
    marks = a.unionByName(rows.withColumn("_a", F.lit(False)), allowMissingColumns=True)
    pair = F.struct("y", "n")
    up = whole.orderBy(F.col("y"), F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = whole.orderBy(F.col("y").desc(), F.col("_a").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = {"_lo": F.last(F.when(F.col("_a"), pair), ignorenulls=True).over(up), "_hi": F.last(F.when(F.col("_a"), pair), ignorenulls=True).over(down)}
    held = {"_size": F.coalesce(F.max("_c").over(whole), F.lit(0)), **{f"_{n}": F.max(F.when(i, pair)).over(whole) for n, i in (("e0", F.col("_i") == 1), ("e1", F.col("_i") == 2), ("z1", F.col("_i") == F.col("_c") - 1), ("z0", F.col("_i") == F.col("_c")))}}
    out = marks.withColumns({**near, **held}).where("not _a")
    size = F.col("_size")
    lo = F.when(F.col("_lo").isNull(), F.col("_e0")).when(F.col("_hi").isNull(), F.col("_z1")).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo").isNull(), F.col("_e1")).when(F.col("_hi").isNull(), F.col("_z0")).otherwise(F.col("_hi"))
    at = out.withColumns({"_l": lo, "_h": hi})
    dy = F.nullif(F.col("_h.y") - F.col("_l.y"), F.lit(0.0))
    value = F.when(size == 0, 1.0).when(size == 1, F.col("_e0.n").cast("double")).otherwise(F.coalesce(F.col("_l.n") + (F.col("y") - F.col("_l.y")) / dy * (F.col("_h.n") - F.col("_l.n")), F.col("_l.n").cast("double")))
    return at.withColumn("printed", F.greatest(F.lit(1), F.bround(value).cast("int"))).drop("_a", "_i", "_c", "_lo", "_hi", *held, "_l", "_h", "n")


def carried_columns(pages: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """doc, page, column: the left column of each page, carried over pages in order.

    pages: doc, page, own (the page's own left column or null), counts (whether the page takes part in the carry and has
    lines). A page takes its own column unless the pages before it have gone beyond that; without one, what
    follows the last page's pair, or 1. What is carried after a page is the larger of two sums, so
    it is a running maximum over running sums: no page waits for the one before it.
    """
    w = Window.partitionBy(doc).orderBy(page)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    up = F.when(F.col("counts"), 2).otherwise(0)
    rows = pages.withColumn("_s", F.sum(up).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    least = F.when(F.col("counts"), F.coalesce("own", F.lit(1)) + 2 - F.col("_s"))
    so_far = F.max(least).over(before) + F.col("_s") - up
    return rows.select(doc, page, F.coalesce(F.greatest("own", so_far), F.lit(1)).cast("int").alias("column"))


READ = "own int, side int, seq int, printed_line int, box struct<x0:double,y0:double,x1:double,y1:double>, source_text string, confidence double, reference_method string, reference_confidence string, paragraph_start boolean, indent_level int"
WORD = ["text", "x0", "y0", "x1", "y1", "confidence"]
#: What a page's own row carries; its words have nulls there.
INFO = ["own", "header_y", "marks", "gutter_x", "lo", "hi"]
SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def grant_entries(words: DataFrame, method: str = "native") -> DataFrame:
    """Entries of grants, cited by column and printed line.

    A page is read by itself, into lines of its left and right side. Their columns
    follow from the pages' own column pairs and how these carry over pages, and
    their ordinals from how many lines the pages before have; both take one row a page.
    """
    cols = ["doc_id", "page_index", "word_ix", "text", "x0", "y0", "x1", "y1", "confidence"]
    w = stored(words.select(*cols), "words")  # six steps read them
    pages = w.select(*PAGE).distinct().join(column_headers(w), PAGE, "left").join(running_header(w), PAGE, "left")
    pages = stored(pages.select(*PAGE, F.col("left_column").alias("own"), F.greatest(F.lit(CONTENT_TOP), F.coalesce("header_y", F.lit(0.0)), F.coalesce("running_y", F.lit(0.0))).alias("header_y")), "pages")
    gutter = gutter_numbers(w, pages).groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("cy", "n"))).alias("marks"), F.median("cx").alias("gutter_x"), (F.min("x0") - 0.004).alias("lo"), (F.max("x1") + 0.004).alias("hi")
    )
    rows = w.select(*PAGE, "word_ix", *WORD).unionByName(pages.join(gutter, PAGE, "left").withColumn("_page", F.lit(True)), allowMissingColumns=True)
    rows = rows.where("doc_id is not null and page_index is not null").repartition(*PAGE).sortWithinPartitions(*PAGE, F.col("_page").desc_nulls_last(), "word_ix")
    schema = _parse_datatype_string("doc_id {}, page_index {}, {}".format(*(w.schema[c].dataType.simpleString() for c in PAGE), READ))
    names, arrow = schema.names, to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_pages(batches):
            yield from _read_pages(some, method).select(names).cast(arrow).to_batches()

    lines = stored(rows.mapInArrow(read, schema), "lines")
    each = lines.groupBy(*PAGE).agg(F.first("own").alias("own"), F.count("*").alias("n"), F.lit(True).alias("counts"))
    column = carried_columns(each).withColumnRenamed("column", "_left")
    begin = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = column.join(each.select(*PAGE, begin.alias("_begin")), PAGE)
    ordinal = (F.col("_begin") + F.col("seq")).cast("int")
    return lines.join(placed, PAGE).select(
        *PAGE, ordinal.alias("ordinal"), (F.col("_left") + F.col("side")).alias("column"), *names[5:], entry_id(ordinal).alias("entry_id"), F.col("source_text").alias("display_text")
    )


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows cut before pages: each table begins with a page's own row and holds all words of its last page."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = np.flatnonzero(b.column("_page").is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            if held or at[-1]:
                yield pa.Table.from_batches([*held, b.slice(0, at[-1])])
            held = []
        held.append(b.slice(at[-1] if len(at) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.diff(key, prepend=-1))


def _medians(values: np.ndarray, key: np.ndarray, n: int, default: float) -> np.ndarray:
    """The median of the values of each key from 0 to n - 1."""
    out = np.full(n, default)
    values, key = values[order := np.lexsort((values, key))], key[order]
    at = _starts(key)
    size = np.diff(at, append=len(key))
    out[key[at]] = (values[at + (size - 1) // 2] + values[at + size // 2]) / 2
    return out


def _anchors(pages: pa.Table) -> tuple[np.ndarray, ...]:
    """Of each page: whether it is read, heights and numbers of its anchors (filled up with infinity), how many, where the middle is and what the strip takes in.

    A page that has neither a column pair nor three line numbers that rise evenly is not read.
    """
    own, start = pages.column("own").is_valid().to_numpy(), pages.column("header_y").to_numpy() + HEADER_PAD
    middle, lo, hi = (pages.column(c).to_numpy().astype(float) for c in ("gutter_x", "lo", "hi"))
    marks = pages.column("marks").combine_chunks()
    cy, n = (marks.flatten().field(c).to_pylist() for c in ("cy", "n"))
    sizes = np.array([x or 0 for x in pc.list_value_length(marks).to_pylist()], int)
    found, at = [], 0
    for size in sizes.tolist():
        found.append(progression(list(zip(cy[at : at + size], n[at : at + size]))))
        at += size
    count = np.array([len(x) for x in found], int)
    able, few = own | (count >= 3), count < 2
    middle[few], lo[few], hi[few] = 0.5, -1.0, -1.0
    for i in np.flatnonzero(few).tolist():
        found[i] = [(start[i], 1), (0.94, LINES_PER_COLUMN)]
    count[few] = 2
    ys, ns = np.full((len(found), max(count, default=2)), np.inf), np.zeros((len(found), max(count, default=2)))
    for i, x in enumerate(found):
        ys[i, : len(x)], ns[i, : len(x)] = zip(*x)
    return able, ys, ns, count, start, middle, lo, hi


def _read_pages(rows: pa.Table, method: str) -> pa.Table:
    """The lines (as READ) of whole pages, each its own row and then its words, all pages at once."""
    first = rows.column("_page").is_valid().to_numpy()
    pages, words = rows.filter(pa.array(first)), rows.filter(pa.array(~first))
    able, ys, ns, count, start, middle, lo, hi = _anchors(pages)
    page = (np.cumsum(first) - 1)[~first]
    x0, y0, x1, y1 = (words.column(c).to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1"))  # a null is NaN here, which no comparison takes
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    m = middle[page]
    at = np.flatnonzero(able[page] & (start[page] < cy) & (cy <= CONTENT_BOTTOM) & ((cx < m - 0.005) | (cx > m + 0.005)))
    page, x0, y0, x1, y1, cx, cy = (v[at] for v in (page, x0, y0, x1, y1, cx, cy))
    side = page * 2 + (cx > middle[page])  # a page's left and right
    line = _line_of(side, cy, x0, y1 - y0, 2 * len(able))
    by = np.argsort(line, kind="stable")
    begin = _starts(line[by])
    mean_y = np.add.reduceat(cy[by], begin) / np.diff(begin, append=len(by)) if len(by) else cy
    # a line's words from left to right, without the strip's
    kept = np.flatnonzero(~((lo[page] <= cx) & (cx <= hi[page])))
    kept = kept[np.lexsort((x0[kept], line[kept]))]
    page, x0, y0, x1, y1, line = (v[kept] for v in (page, x0, y0, x1, y1, line))
    side = side[kept]
    begin = _starts(line)
    size = np.diff(begin, append=len(line))
    word = words.take(pa.array(at[kept]))
    text = _joined(word.column("text").combine_chunks(), begin, size, x0, x1, method == "ocr")
    y = mean_y[line[begin]]
    ok = (y >= start[page[begin]]) & pc.not_equal(text, "").to_numpy(zero_copy_only=False) & ~_lone_number(text, size)
    edges = [f.reduceat(v, begin) if len(begin) else v for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    high = y1 - y0
    of = np.repeat(np.arange(len(begin)), size)
    unit = np.maximum(0.008, _medians(high[high > 0], of[high > 0], len(begin), 0.012) * 0.65)
    sure = word.column("confidence").is_valid().to_numpy()
    values = word.column("confidence").to_numpy().astype(float)[sure]
    seen = _starts(of[sure])
    conf = np.full(len(begin), np.nan)
    if len(seen):
        conf[of[sure][seen]] = np.add.reduceat(values, seen) / np.diff(seen, append=len(values))
    # the lines that stay
    begin, y, unit, conf, text = begin[ok], y[ok], unit[ok], conf[ok], text.filter(pa.array(ok))
    ex0, ey0, ex1, ey1 = (v[ok] for v in edges)
    page, side = page[begin], side[begin]
    after = np.diff(side, prepend=-1) == 0
    gap = np.where(after, np.diff(y, prepend=0.0), 0.0)
    typical = _medians(gap[gap > 0], side[gap > 0], 2 * len(able), 0.0)[side]
    offset = ex0 - _medians(ex0, side, 2 * len(able), 0.0)[side]
    indent = np.where(offset < unit * 0.55, 0, np.clip(np.rint(offset / unit), 1, 6)).astype(np.int32)
    apart = after & (typical > 0) & (gap >= np.maximum(0.018, 1.6 * typical))
    printed = np.maximum.accumulate(printed_lines(ys[page], ns[page], count[page], y) + (side << 40)) - (side << 40)  # never falls on a side
    on = (np.abs(y[:, None] - ys[page]) <= ROW_TOLERANCE).any(1)
    ex0, ey0, ex1, ey1 = (np.clip(v, 0.0, 1.0) for v in (ex0, ey0, ex1, ey1))
    ex1, ey1 = np.where(ex1 > ex0, ex1, np.minimum(1.0, ex0 + 1e-4)), np.where(ey1 > ey0, ey1, np.minimum(1.0, ey0 + 1e-4))
    head = _starts(page)
    seq = np.arange(len(page)) - np.repeat(head, np.diff(head, append=len(page)))
    own = pages.select([*PAGE, "own"]).take(pa.array(page))
    pick = lambda a, b: pc.if_else(pa.array(on), a, b)
    read = {
        "side": pa.array((side % 2).astype(np.int32)), "seq": pa.array(seq.astype(np.int32)), "printed_line": pa.array(printed.astype(np.int32)), "box": pa.StructArray.from_arrays([pa.array(v) for v in (ex0, ey0, ex1, ey1)], ["x0", "y0", "x1", "y1"]),
        "source_text": text, "confidence": pa.array(conf, from_pandas=True), "reference_method": pick("detected", "interpolated"), "reference_confidence": pick("high", "medium"), "paragraph_start": pa.array((indent > 0) | apart), "indent_level": pa.array(indent),
    }
    return pa.table([*own.columns, *read.values()], [*own.column_names, *read])


def _line_of(side: np.ndarray, cy: np.ndarray, x0: np.ndarray, heights: np.ndarray, n: int) -> np.ndarray:
    """The line of each word, as line_numbers has it for each side, numbered on over all of them."""
    high = heights > 0
    reach = np.maximum(_medians(heights[high], side[high], n, 0.01) * RATIO, 1e-4)
    out, order = np.zeros(len(side), int), np.lexsort((x0, cy, side))
    number, last, line, total, size = [], -1, -1, 0.0, 1
    for s, y, r in zip(side[order].tolist(), cy[order].tolist(), reach[side[order]].tolist()):
        if s != last or abs(y - total / size) > r:
            last, line, total, size = s, line + 1, y, 1
        else:
            total += y
            size += 1
        number.append(line)
    out[order] = number
    return out


def _joined(texts: pa.Array, begin: np.ndarray, size: np.ndarray, x0: np.ndarray, x1: np.ndarray, tabs: bool) -> pa.Array:
    """Words of each line in order; with tabs, gaps of about three characters are one to four of them."""
    texts, sep = pc.fill_null(texts, ""), " "
    if tabs:
        letters, of = pc.utf8_length(pc.utf8_trim(texts, SPACE)).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(begin)), size)
        some = (x1 > x0) & (letters > 0)
        char = _medians((x1 - x0)[some] / letters[some], of[some], len(begin), 0.0)[of]
        gap = np.maximum(0.0, x0 - np.concatenate([x1[:1], x1[:-1]]))
        wide = (char > 0) & (gap >= np.maximum(0.012, 2.75 * char))
        n = np.where(wide, np.clip(np.rint(gap / np.maximum(4 * char, 0.018)), 1, 4), 0).astype(int)
        n[begin] = 5
        texts, sep = pc.binary_join_element_wise(pa.array([" ", "\t", "\t\t", "\t\t\t", "\t\t\t\t", ""]).take(pa.array(n)), texts, ""), ""
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(x0)).astype(np.int32)), texts)
    return pc.utf8_trim(pc.binary_join(lists, sep), SPACE)


def _lone_number(text: pa.Array, size: np.ndarray) -> np.ndarray:
    """Which lines are one word of at most three digits, with or without full stops."""
    maybe = np.flatnonzero((size == 1) & pc.match_substring_regex(text, r"^[^A-Za-z]{1,3}\.*$").to_numpy(zero_copy_only=False))
    out = np.zeros(len(size), bool)
    out[maybe] = [t.rstrip(".").isdigit() and len(t.rstrip(".")) <= 3 for t in text.take(pa.array(maybe)).to_pylist()]
    return out


def _read_page(words: list[dict], method: str) -> list[tuple]:
    """The lines of one page (READ, without own), whose words carry what is known of it."""
    info = {c: words[0][c] for c in INFO}
    kinds = {"own": pa.int32(), "marks": pa.list_(pa.struct([("cy", pa.float64()), ("n", pa.int32())])), "text": pa.string(), "_page": pa.bool_(), **{c: pa.int32() for c in PAGE}}
    rows = [{**info, "_page": True}, *({c: w[c] for c in WORD} for w in words)]
    names = [*PAGE, *WORD, *INFO, "_page"]
    table = pa.table([pa.array([r.get(c) for r in rows], kinds.get(c, pa.float64())) for c in names], names)
    return [tuple(r.values())[3:] for r in _read_pages(table, method).to_pylist()]
