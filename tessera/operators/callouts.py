"""Reference numerals on drawings: detection, evidence from the text, choice of readings, and word merging."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.functions import geometry as G
from tessera.functions.text import confusion_fixed, is_sheet_header
from tessera.operators.groups import each_group
from tessera.operators.lines import grouped_lines
from tessera.operators.rounds import one_a_spot
from tessera.store import stored

PAGE = ["doc_id", "page_index"]
# The form of a numeral, the characters trimmed off it, and the score parts and limits.
NUMERAL = r"^[0-9]{2,4}[A-Z]?$"
TRIM = ".,;:()[]{}"
SUPPORTED, ALONE = 0.34, 0.70


def sheet_headers(words: DataFrame) -> DataFrame:
    """PAGE, bottom: the lowest edge of a `Sheet x of y` row at the top, or of the whole band if both words stand in it."""
    band = words.where((F.col("y0") + F.col("y1")) / 2 <= 0.12)
    rows = grouped_lines(band).groupBy(*PAGE, "line_ix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_ix", "text"))), lambda w: w["text"]), " ").alias("t"), F.max("y1").alias("y1")
    )
    t = F.lower("t")
    per = rows.groupBy(*PAGE).agg(
        F.max(F.when(is_sheet_header(F.col("t")), F.col("y1"))).alias("line"), F.max("y1").alias("band"),
        F.bool_or(t.rlike(r"\bsheet\b")).alias("a"), F.bool_or(t.rlike(r"\bof\b")).alias("b"),
    )
    return per.select(*PAGE, F.coalesce("line", F.when(F.col("a") & F.col("b"), F.col("band"))).alias("bottom")).where("bottom is not null")


def without_headers(words: DataFrame) -> DataFrame:
    """Words of pages with a sheet header only from below it."""
    h = sheet_headers(words)
    cut = F.greatest(F.lit(0.10), F.col("bottom") + 0.02)
    return words.join(h, PAGE, "left").where(F.col("bottom").isNull() | ((F.col("y0") + F.col("y1")) / 2 > cut)).drop("bottom")


def drawing_pages(pages: DataFrame, words: DataFrame, most: int = 120, least: float = 0.30) -> DataFrame:
    """PAGE, is_drawing: a sheet header says so; else few words, at least three tenths of them numerals; a page without words is one."""
    h = sheet_headers(words).select(*PAGE, F.lit(True).alias("_h"))
    body = without_headers(words).groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.trim("text").rlike("^[0-9]{1,4}[A-Za-z]?$")).alias("k"))
    both = pages.select(*PAGE).join(h, PAGE, "left").join(body, PAGE, "left")
    n = F.coalesce("n", F.lit(0))
    sparse = (n == 0) | ((n <= most) & (F.col("k") / F.nullif(n, F.lit(0)) >= least))
    return both.select(*PAGE, (F.coalesce("_h", F.lit(False)) | sparse).alias("is_drawing"))


def strength(confidence: Column) -> Column:
    """0.96 of native text, else the confidence as a part of one."""
    return F.when(confidence.isNull(), 0.96).otherwise(F.least(F.greatest(confidence / 100.0, F.lit(0.0)), F.lit(1.0)))


def trimmed(text: Column) -> Column:
    return F.upper(F.btrim(F.trim(text), F.lit(TRIM)))


def is_numeral(value: Column) -> Column:
    return value.rlike(NUMERAL) & ~value.rlike("^(19|20)[0-9]{2}$")


def readings(token: Column) -> Column:
    """The numerals that a drawing's token may stand for: as it is, with letters that look like digits replaced, and that with its last letter kept."""
    runs = F.regexp_extract_all(F.upper(F.trim(token)), F.lit(r"(?<![A-Z0-9])[0-9ILOQSBZ]{2,4}[A-Z]?(?![A-Z0-9])"), F.lit(0))
    some = F.filter(runs, lambda r: r.rlike("[0-9]"))

    def of(r: Column) -> Column:
        fixed = confusion_fixed(r)
        kept = F.concat(confusion_fixed(F.substring(r, F.lit(1), F.length(r) - 1)), F.right(r, F.lit(1)))
        whole = F.when(fixed.rlike("^[0-9]{2,4}$") & is_numeral(fixed), fixed)
        ends = F.when((F.length(r) >= 3) & r.rlike("[A-Z]$") & is_numeral(kept) & ~kept.rlike("^(19|20)[0-9]{2}"), kept)
        return F.array(F.when(is_numeral(r), r), whole, ends)

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(some, of)))))


def evidence(words: DataFrame, mentions: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, value, support: 1.0 for bold numerals within the text columns, 0.72 for values mentioned."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    value = trimmed(F.col("text"))
    bold = words.where(F.coalesce("is_bold", F.lit(False)) & cy.between(0.075, 0.95) & cx.between(0.08, 0.92) & ~cx.between(0.47, 0.53)).select(*keys, value.alias("value"), F.lit(1.0).alias("support"))
    said = mentions.select(*keys, F.upper(F.trim("value")).alias("value"), F.lit(0.72).alias("support"))
    return bold.unionByName(said).where(is_numeral(F.col("value"))).groupBy(*keys, "value").agg(F.max("support").alias("support"))


def detected(words: DataFrame, figures: DataFrame) -> DataFrame:
    """Words that may be numerals and whose centre is in no figure label of the page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w = without_headers(words).withColumns({"value": trimmed(F.col("text")), "_x": cx, "_y": cy})
    w = w.where(F.size(readings(F.col("value"))) > 0)
    inside = (F.col("_x").between(F.col("_f.x0"), F.col("_f.x1"))) & (F.col("_y").between(F.col("_f.y0"), F.col("_f.y1")))
    f = figures.select(*[F.col(k).alias(f"_{k}") for k in PAGE], F.col("box").alias("_f"))
    free = w.join(f, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_index") == F.col("_page_index")) & inside, "left_anti")
    box = G.clamped(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return free.select(*PAGE, F.format_string("callout_%04d_%04d", "page_index", "word_ix").alias("callout_id"), "value", box.alias("box"), "confidence")


def chosen(callouts: DataFrame, support: DataFrame) -> DataFrame:
    """Callouts with the reading that the text supports best and their score; weak ones go, and of readings on one spot the best stays.

    A reading that is one insertion or deletion off exactly one supported value
    counts three quarters. The spot rule goes from the best score down.
    """
    once = lambda x: F.explode(F.array(x))  # noqa: E731  # a filter that reads the column does not work it out again
    c = callouts.withColumn("r", once(readings(F.col("value")))).where(F.size("r") > 0)
    ev = support.where("value is not null").groupBy("doc_id").agg(F.collect_set(F.struct("support", F.col("value").alias("v"))).alias("ev"))
    rows = c.join(ev, "doc_id", "left").withColumn("_raw", F.upper("value"))
    own = F.filter("ev", lambda x: F.array_contains("r", x["v"]))
    e = F.array_max(F.transform(own, lambda x: F.struct((x["v"] == F.col("_raw")).alias("own"), x["support"].alias("support"), x["v"].alias("v"))))
    one_off = lambda a, b: (F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) == 1)
    near = F.filter("ev", lambda x: F.exists("r", lambda r: one_off(x["v"], r)))
    rows = rows.withColumn("_s", once(F.struct(e.alias("e"), near.alias("near"))))
    one = F.when(F.size("_s.near") == 1, F.get("_s.near", F.lit(0)))
    rows = rows.withColumns({"e": F.col("_s.e"), "nv": one["v"], "ns": one["support"]})
    longest = F.array_max(F.transform("r", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    s = F.when(F.col("e").isNotNull(), F.col("e.support")).otherwise(F.coalesce(F.col("ns") * 0.75, F.lit(0.0)))
    ocr = strength(F.col("confidence"))
    rows = rows.withColumns({"value": F.coalesce("e.v", "nv", longest), "support": s}).withColumn("score", F.when(F.col("support") > 0, 0.60 * ocr + 0.40 * F.col("support")).otherwise(0.82 * ocr))
    rows = rows.withColumn("method", F.when(F.coalesce(F.col("e.own"), F.lit(False)), "spec_exact").when(F.col("support") > 0, "spec_fuzzy").otherwise("drawing_only"))
    rows = rows.where(F.col("score") >= F.when(F.col("support") > 0, SUPPORTED).otherwise(ALONE)).select(*PAGE, "callout_id", "value", "box", "confidence", F.bround("score", 3).alias("score"), "method")
    return one_a_spot(stored(rows, "callouts"), PAGE, "callout_id", [-F.col("score"), F.col("callout_id")])


def _iou(a, b) -> float:
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inter
    return inter / union if union > 0 else 0.0


def _near(a, b) -> bool:
    return _iou(a, b) >= 0.25 or ((a["x0"] + a["x1"] - b["x0"] - b["x1"]) ** 2 + (a["y0"] + a["y1"] - b["y0"] - b["y1"]) ** 2) ** 0.5 / 2 <= 0.008


def _within(a, b) -> float:
    """The overlap as a part of the smaller box."""
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    least = min((x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (a, b))
    return max(w, 0.0) * max(h, 0.0) / least if least > 0 else 0.0


def _letters(text: str) -> str:
    return text.strip().casefold()


def _placed(w: dict) -> dict:
    """A word whose unknown edges are no number, which no spot equals."""
    return {**w, **{e: math.nan for e in ("x0", "y0", "x1", "y1") if w[e] is None}}


def _sure(confidence) -> float:
    return 0.0 if pd.isna(confidence) else float(confidence)


def merged_words(words: DataFrame, keys: Sequence[str] = tuple(PAGE)) -> DataFrame:
    """Words of several readings of a page, each place once.

    Equal words on one spot are one, as are two of which one holds the other and
    ends where it ends; the one with more letters and digits stays, then the wider, then the surer.
    """

    rank = lambda w: (sum(c.isalnum() for c in w["text"]), max(0.0, w["x1"] - w["x0"]), _sure(w["confidence"]))
    cy = lambda w: (w["y0"] + w["y1"]) / 2
    at = lambda v: math.floor(v / 0.0081) if math.isfinite(v) else 0
    cell = lambda w: (at(cy(w)), at(w["x1"]))

    def merge(rows: list[dict]) -> list[list]:
        kept: list[dict] = []
        by_text: dict[str, dict[int, None]] = {}
        by_cell: dict[tuple[int, int], dict[int, None]] = {}
        for w in sorted(map(_placed, rows), key=lambda w: (-_sure(w["confidence"]), cy(w), w["x0"], w["word_ix"])):
            text, (y, x) = _letters(w["text"]), cell(w)
            around = {n for i in (y - 1, y, y + 1) for j in (x - 1, x, x + 1) for n in by_cell.get((i, j), ())}
            for n in sorted(around.union(by_text.get(text, ()))):
                k = kept[n]
                same = _letters(k["text"]) == text and _near(k, w)
                if same or (abs(cy(k) - cy(w)) <= 0.008 and _within(k, w) >= 0.82 and abs(k["x1"] - w["x1"]) <= 0.008):
                    if rank(w) > rank(k):
                        del by_text[_letters(k["text"])][n], by_cell[cell(k)][n]
                        kept[n] = w
                        by_text.setdefault(text, {})[n] = by_cell.setdefault((y, x), {})[n] = None
                    break
            else:
                by_text.setdefault(text, {})[len(kept)] = by_cell.setdefault((y, x), {})[len(kept)] = None
                kept.append(w)
        return [list(w.values()) for w in kept]

    return each_group(words, keys, ["word_ix"], merge, words.schema)


def fused_words(words: DataFrame, keys: Sequence[str] = tuple(PAGE)) -> DataFrame:
    """Equal words on one spot as the surest of them, two points surer for each further reading, eight at most."""

    def fuse(rows: list[dict]) -> list[list]:
        groups: list[list[dict]] = []
        by_text: dict[str, list[list[dict]]] = {}
        for w in map(_placed, rows):
            known = by_text.setdefault(_letters(w["text"]), [])
            for g in known:
                if _near(g[0], w):
                    g.append(w)
                    break
            else:
                known.append([w])
                groups.append(known[-1])
        out = []
        for g in groups:
            best = dict(max(g, key=lambda w: _sure(w["confidence"])))
            if len(g) > 1 and not pd.isna(best["confidence"]):
                best["confidence"] = min(100.0, best["confidence"] + min(8.0, 2.0 * (len(g) - 1)))
            out.append(list(best.values()))
        return out

    return each_group(words, keys, ["word_ix"], fuse, words.schema)


def strongest_figures(occurrences: DataFrame, expected: DataFrame) -> DataFrame:
    """Per page and figure the best-scored label; on pages with three or more ids that the text lacks, those go.

    occurrences: PAGE, figure_id, box, confidence, method, position; expected: doc_id, figure_id.
    """
    norm = F.upper(F.regexp_replace("figure_id", r"\s+", ""))
    e = expected.select("doc_id", F.upper(F.regexp_replace("figure_id", r"\s+", "")).alias("_e")).distinct()
    o = occurrences.withColumn("_n", norm)
    fixed = F.regexp_extract(confusion_fixed(F.col("_n"), drawing=True), "^([0-9]+)[A-Z]?$", 1)
    exact = o.join(e, (o["doc_id"] == e["doc_id"]) & (F.col("_n") == F.col("_e")), "left").select(o["*"], F.col("_e").alias("_x"))
    e2 = e.withColumnsRenamed({"doc_id": "_d", "_e": "_e2"})
    both = exact.join(e2, (F.col("doc_id") == F.col("_d")) & (fixed == F.col("_e2")), "left")
    ocr = F.when(F.col("method") == "native_text", 1.0).otherwise(strength(F.col("confidence"))) * F.when(F.col("method") == "sparse_ocr_confusable", 0.92).when(F.col("method") == "fuzzy_prefix", 0.82).otherwise(1.0)
    support = F.when(F.col("_x").isNotNull(), 1.0).when(F.col("_e2").isNotNull(), 0.82).otherwise(0.0)
    rows = both.withColumns({"support": support, "ocr": ocr}).withColumn("score", F.when(F.col("support") > 0, 0.62 * F.col("ocr") + 0.38 * F.col("support")).otherwise(0.82 * F.col("ocr")))
    rows = rows.where(F.col("score") >= F.when(F.col("support") == 1.0, 0.34).when(F.col("support") > 0, 0.30).otherwise(0.70))
    rows = rows.withColumns({"figure_id": F.coalesce("_x", "_e2", "_n"), "method": F.when(F.col("support") == 1.0, "spec_exact").when(F.col("support") > 0, "spec_fuzzy").otherwise("drawing_only"), "score": F.bround("score", 3)})
    w = Window.partitionBy(*PAGE, "figure_id").orderBy(F.desc("score"), "position")
    best = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    crowd = F.size(F.collect_set(F.when(F.col("support") == 0, F.col("figure_id"))).over(Window.partitionBy(*PAGE)))
    some = e.select(F.col("doc_id").alias("_sd")).distinct()
    best = best.withColumn("_c", crowd).join(some, F.col("doc_id") == F.col("_sd"), "left")
    return best.where(F.col("_sd").isNull() | (F.col("_c") < 3) | (F.col("support") > 0)).select(*PAGE, "figure_id", "box", "confidence", "score", "method", "position")


def sequence(labels: list[tuple[int, tuple[int, int], float]]) -> set[tuple[int, tuple[int, int]]]:
    """The longest run of (page, figure key, score) in which keys rise strictly while pages do not fall; of equal lengths the one
    that ends at the lower key, then page, then the heavier."""
    best: dict[tuple[int, tuple[int, int]], float] = {}
    for page, key, s in labels:
        best[page, key] = max(s, best.get((page, key), 0.0))
    nodes = sorted(best)
    rank = {k: r for r, k in enumerate(sorted({k for _, k in nodes}), 1)}
    tops: list[tuple[int, float, int]] = [(0, 0, 1)] * (len(rank) + 1)  # the best chain's end over ranges of lower keys
    chain: list[tuple[int, float, int]] = []
    for i, (page, key) in enumerate(nodes):
        ahead, r = (0, 0, 1), rank[key] - 1
        while r > 0:
            ahead, r = max(ahead, tops[r]), r & (r - 1)
        n, w, j = ahead
        chain.append((n + 1, w + best[page, key], -j))
        end, r = (n + 1, w + best[page, key], -i), rank[key]
        while r < len(tops):
            tops[r], r = max(tops[r], end), r + (r & -r)
    if not nodes:
        return set()
    i = max(range(len(nodes)), key=lambda k: (chain[k][0], tuple(-x for x in nodes[k][1]), -nodes[k][0], chain[k][1]))
    out = set()
    while i >= 0:
        out.add(nodes[i])
        i = chain[i][2]
    return out


def sequenced_figures(figures: DataFrame) -> DataFrame:
    """figures with in_sequence: whether the label is on the document's longest rising run of figures over its pages."""
    from tessera.functions.text import figure_key

    rows = figures.withColumn("_k", figure_key(F.col("figure_id")))
    schema = StructType([*figures.schema, StructField("in_sequence", BooleanType())])

    def run(group: list[dict]) -> list[list]:
        keys = [(k["number"], k["suffix"]) if k is not None else None for k in (x.pop("_k") for x in group)]
        held = sequence([(int(x["page_index"]), k, float(x["score"] or 0.0)) for x, k in zip(group, keys) if k])
        return [[*x.values(), k is not None and (int(x["page_index"]), k) in held] for x, k in zip(group, keys)]

    return each_group(rows, ["doc_id"], ["page_index"], run, schema)


# What a label gains in the run, loses a little or far out of it, how far is little, and the least scores with the text's support and without.
IN_RUN, NEARLY, FAR, NEAR_BY, WITH_TEXT, WITHOUT_TEXT = 0.04, -0.04, -0.20, 2, 0.34, 0.70


def rescored_figures(figures: DataFrame) -> DataFrame:
    """figures (with in_sequence) scored anew by where they stand to the document's run; weak ones go, and of an id that the run holds, its places outside the run.

    How far a label is out of order is by how much it is below the largest key of the
    run on pages before it, or above the smallest on pages after it. Labels without a number stay as they are.
    """
    from tessera.functions.text import figure_key

    key = F.struct(F.col("_k.number").alias("number"), F.col("_k.suffix").alias("suffix"))
    rows = figures.withColumn("_k", figure_key(F.col("figure_id"))).withColumn("_k", F.when(F.col("_k").isNotNull(), key))
    run = F.when(F.col("in_sequence") & F.col("_k").isNotNull(), F.col("_k"))
    pages = rows.groupBy(*PAGE).agg(F.max(run).alias("_most"), F.min(run).alias("_least"))
    w = Window.partitionBy("doc_id").orderBy("page_index")
    around = pages.select(*PAGE, F.max("_most").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_least").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    rows = rows.join(around, PAGE)
    below = F.when(F.col("_k") < F.col("_before"), F.col("_before.number") - F.col("_k.number"))
    above = F.when(F.col("_k") > F.col("_after"), F.col("_k.number") - F.col("_after.number"))
    off = F.greatest(F.lit(0), F.coalesce(below, F.lit(0)), F.coalesce(above, F.lit(0)))
    change = F.when(F.col("in_sequence"), IN_RUN).when(off <= NEAR_BY, NEARLY).otherwise(FAR)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0)) + change))
    numbered = F.col("_k").isNotNull()
    rows = rows.withColumn("_s", score).where(~numbered | (F.col("_s") >= F.when(F.col("method").startswith("spec_"), WITH_TEXT).otherwise(WITHOUT_TEXT)))
    rows = rows.withColumn("score", F.when(numbered, F.bround("_s", 3)).otherwise(F.col("score")))
    held = F.max(F.col("in_sequence") & numbered).over(Window.partitionBy("doc_id", "figure_id"))
    return rows.withColumn("_h", held).where(~F.col("_h") | (F.col("in_sequence") & numbered)).select(figures.columns)
