"""Figure labels on drawing sheets: detection on words, reconciliation with the text, and labels that recognition missed.

All decisions are within one document, over few labels; a document is one group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import figure_key
from tessera.operators.callouts import without_headers
from tessera.operators.lines import PAGE, grouped_lines
from tessera.operators.mentions import FIGURE_REFERENCE, expand_figures

Key = tuple[int, int]

# A label's number as drawings show it, what recognition makes of the word before it, and letters read for digits.
LOOSE_NUMBER = re.compile(r"\b(?:FIGS?|FIGURES?)\s*\.?\s*([0-9ILOilo]+(?:[A-Za-z](?![A-Za-z])|\s+[A-Za-z](?![A-Za-z]))?)", re.IGNORECASE)
LOOSE_WORD = re.compile(r"\b(?:F[1IilL|!]{1,2}[Gg6Cc][Ss5]?|[FfRrSs][iI1lL][gqG9][uoU0][rnR][eaEA3][sS5]?)[.,;:'`]*\s*([0-9ILOQSBZFW|iloqsbzfw]+(?:[A-Za-z](?![A-Za-z])|\s+[A-Za-z](?![A-Za-z]))?)")
LETTERS_AS_DIGITS = "IL|WOQSBZF", "1111005827"
LABEL_SCHEMA = "figure_id string, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double, method string"


def key_of(figure_id: str) -> Key | None:
    m = re.fullmatch(r"(\d+)([A-Z]?)", re.sub(r"\s", "", figure_id).upper())
    return (int(m[1]), ord(m[2]) - 64 if m[2] else 0) if m else None


def id_of(key: Key) -> str:
    return f"{key[0]}{chr(64 + key[1]) if key[1] else ''}"


def loose_ids(token: Column) -> Column:
    """Ids that a badly read label may stand for, in order: all its letters read as digits, or all but the last; a letter that repeats may be one."""
    whole = F.upper(F.regexp_replace(token, r"\s", ""))
    spellings = F.array(whole, F.regexp_replace(whole, r"([A-Z])\1+", "$1"))
    digits = lambda x: F.translate(x, *LETTERS_AS_DIGITS)
    ending = lambda x: F.concat(digits(F.left(x, F.greatest(F.length(x) - 1, F.lit(0)))), F.right(x, F.lit(1)))
    every = F.concat(F.transform(spellings, digits), F.transform(spellings, ending))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.rlike("^[0-9]+[A-Z]?$"))))


def detected(words: DataFrame) -> DataFrame:
    """PAGE and LABEL_SCHEMA: labels on the lines of each sheet, headers left out; loose readings only on lines without a proper label."""
    schema = f"doc_id {words.schema['doc_id'].dataType.simpleString()}, page_index int, seq int, expr string, loose boolean, box struct<x0:double,y0:double,x1:double,y1:double>, confidence double, method string"

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, line in pdf.sort_values(["line_ix", "x0", "word_ix"]).groupby("line_ix", sort=True):
            ends, text = [], ""
            for t in line["text"]:
                start = len(text) + bool(text)
                text = f"{text} {t}" if text else t
                ends.append((start, len(text)))
            sure = [(m, False, "native_text" if line["confidence"].isna().all() else "ocr") for m in re.finditer(FIGURE_REFERENCE, text, re.I)]
            loose = [(m, True, how) for form, how in ((LOOSE_NUMBER, "sparse_ocr_confusable"), (LOOSE_WORD, "fuzzy_prefix")) for m in form.finditer(text)]
            for m, doubtful, method in sure or loose:
                ws = line[[a < m.end() and b > m.start() for a, b in ends]]
                box = {"x0": ws["x0"].min(), "y0": ws["y0"].min(), "x1": ws["x1"].max(), "y1": ws["y1"].max()}
                conf = ws["confidence"].mean()
                out.append((len(out), m[1], doubtful, box, None if pd.isna(conf) else float(conf), method))
        got = pd.DataFrame(out, columns=["seq", "expr", "loose", "box", "confidence", "method"])
        got.insert(0, "page_index", pdf["page_index"].iloc[0])
        got.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        return got

    found = grouped_lines(without_headers(words)).groupBy(*PAGE).applyInPandas(read, schema)
    each = found.select(*PAGE, "seq", F.posexplode(F.when(F.col("loose"), loose_ids(F.col("expr"))).otherwise(expand_figures(F.col("expr")))).alias("i", "figure_id"), "box", "confidence", "method")
    place = [F.bround(F.col(f"box.{e}") * 10_000).alias(f"_{e}") for e in ("x0", "y0", "x1", "y1")]
    w = Window.partitionBy(*PAGE, "figure_id", *place).orderBy("seq", "i")
    return each.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*PAGE, "figure_id", "box", "confidence", "method")


def page_figure(labels: DataFrame) -> DataFrame:
    """PAGE, figure_id: the one figure of a sheet that shows a single one."""
    return labels.groupBy(*PAGE).agg(F.collect_set("figure_id").alias("s")).where(F.size("s") == 1).select(*PAGE, F.get("s", F.lit(0)).alias("figure_id"))


def reconciled(expected: set[str], seen: set[str]) -> set[str]:
    """Ids to expect, after the drawings have been seen.

    Three or more plain numbers that are a lettered family's number and one more
    digit are misread letters, and go. A lettered label that was seen joins a
    family that the text knows if it is at most one letter on. Letters between A and
    a family's last are filled in.
    """
    keys = {k for e in expected if (k := key_of(e))}
    families = {n for n, s in keys if s}
    damaged = {k for k in keys if not k[1] and len(str(k[0])) > 1 and int(str(k[0])[:-1]) in families}
    keys -= damaged if len(damaged) >= 3 else set()
    last = {n: max(s for m, s in keys if m == n) for n, s in keys if s}
    for n, s in sorted(k for e in seen if (k := key_of(e)) and k[1]):
        if n in last and s <= last[n] + 1:
            keys.add((n, s))
            last[n] = max(last[n], s)
    for n, top in last.items():
        if (n, 1) in keys and top > 1:
            keys |= {(n, s) for s in range(1, top + 1)}
    return {id_of(k) for k in keys}


class Sheets:
    """Where figures are known to be, and what is still to be placed."""

    def __init__(self, pages: list[int], placed: dict[Key, tuple[int, float]], expected: set[Key]):
        self.pages, self.placed = sorted(set(pages)), dict(placed)
        lettered = {n for n, s in expected if s}
        # A number named beside its lettered parts is no drawing of its own.
        self.expected = sorted(k for k in expected if k[1] or k[0] not in lettered)
        self.guessed: list[tuple[int, Key, float]] = []

    def on(self, page: int) -> list[Key]:
        return sorted(k for k, (p, _) in self.placed.items() if p == page)

    def numbers(self, page: int) -> list[int]:
        return sorted({n for n, _ in self.on(page)})

    def missing(self, low, high, ends: bool = False) -> list[Key]:
        """Expected keys not placed, strictly between low and high by number (or by key, if those are keys)."""
        of = (lambda k: k) if isinstance(low, tuple) or isinstance(high, tuple) else (lambda k: k[0])
        return [k for k in self.expected if k not in self.placed and (low is None or (low <= of(k) if ends else low < of(k))) and (high is None or (of(k) <= high if ends else of(k) < high))]

    def score(self, *pages: int) -> float:
        tops = [max((s for p, s in self.placed.values() if p == page), default=None) for page in pages]
        return round(min(0.65, 0.65 * min((t for t in tops if t is not None), default=0.55)), 3)

    def place(self, found: list[tuple[int, Key, float]]) -> None:
        for page, key, score in found:
            if key not in self.placed:
                self.placed[key] = (page, score)
                self.guessed.append((page, key, score))

    def blank_runs(self) -> Iterator[tuple[int | None, list[int], int | None]]:
        """The sheet before, the sheets of a run without figures, the sheet after."""
        known = {p for p, _ in self.placed.values()}
        run: list[int] = []
        before = None
        for page in self.pages:
            if page not in known:
                run.append(page)
                continue
            if run:
                yield before, run, page
            before, run = page, []
        if run:
            yield before, run, None


def one_each(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """As many figures missing between two sheets as there are sheets between them."""
    for a, run, b in s.blank_runs():
        if a is not None and b is not None and len(gone := s.missing(s.on(a)[-1], s.on(b)[0])) == len(run):
            yield from ((p, k, s.score(a, b)) for p, k in zip(run, gone))


def spread(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """Numbers missing between two sheets, over the sheets between in proportion; before the first sheet only one number a sheet."""
    for a, run, b in s.blank_runs():
        if b is None:
            continue
        if a is None:
            gone = s.missing(None, s.on(b)[0])
            numbers = sorted({k[0] for k in gone})
            if len(numbers) == len(run):
                yield from ((run[numbers.index(k[0])], k, s.score(b)) for k in gone)
        elif (low := s.numbers(a)[-1]) < (high := s.numbers(b)[0]):
            for k in s.missing(low, high):
                at = int((k[0] - low) * (len(run) + 1) / (high - low) + 0.5)
                yield run[min(len(run), max(1, at)) - 1], k, s.score(a, b)


def shared_run(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """A sheet takes the first of the numbers missing before it, the blank sheets after it the others, if the next sheet goes straight on."""
    for page, run, after in s.blank_runs():
        if page is None or after is None or page == s.pages[0]:
            continue
        prior = s.pages[s.pages.index(page) - 1]
        if not s.on(prior) or s.numbers(after)[0] != s.numbers(page)[-1] + 1:
            continue
        gone = s.missing(s.numbers(prior)[-1], s.numbers(page)[0])
        numbers = sorted({k[0] for k in gone})
        if len(numbers) == len(run) + 1:
            yield from (([page, *run][numbers.index(k[0])], k, s.score(prior, page, after)) for k in gone)


def left_over(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """The single number missing within a sheet's range is on the blank sheet after it, if the next sheet goes straight on."""
    for a, run, b in s.blank_runs():
        if a is None or b is None or len(run) != 1 or s.numbers(b)[0] != s.numbers(a)[-1] + 1:
            continue
        gone = s.missing(s.numbers(a)[0], s.numbers(a)[-1], ends=True)
        if len({k[0] for k in gone}) == 1:
            yield from ((run[0], k, s.score(a, b)) for k in gone)


def siblings(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """Lettered parts of a number are on the sheet of the others."""
    for page in s.pages:
        lettered = {n for n, part in s.on(page) if part}
        yield from ((page, k, s.score(page)) for k in s.missing(None, None) if k[1] and k[0] in lettered)


def holes(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """Numbers missing within the range of a sheet."""
    for page in s.pages:
        if len(n := s.numbers(page)) > 1:
            yield from ((page, k, s.score(page)) for k in s.missing(n[0], n[-1]))


def gaps(s: Sheets) -> Iterator[tuple[int, Key, float]]:
    """Numbers missing between two sheets in a row are on the first."""
    for a, b in zip(s.pages, s.pages[1:]):
        if s.on(a) and s.on(b) and s.numbers(a)[-1] < s.numbers(b)[0]:
            yield from ((a, k, s.score(a, b)) for k in s.missing(s.numbers(a)[-1], s.numbers(b)[0]))


#: In this order; each rule sees what the ones before it have placed.
RULES = (one_each, spread, shared_run, left_over, siblings, holes, gaps)


def inferred(pages: list[int], placed: dict[Key, tuple[int, float]], expected: set[Key]) -> list[tuple[int, Key, float]]:
    """page, key, score of expected figures that no label was read for, as far as the sheets around them bound the place."""
    s = Sheets(pages, placed, expected)
    for rule in RULES:
        s.place(list(rule(s)))
    return s.guessed


class Traced(Sheets):
    """Sheets whose scores are numbers of scores: first those of the labels, then one for each time that a rule asks for one."""

    def __init__(self, pages: list[int], placed: dict[Key, tuple[int, int]], expected: set[Key], n: int):
        super().__init__(pages, placed, expected)
        self.n, self.steps = n, []

    def score(self, *pages: int) -> int:
        self.steps.append([of for page in pages if (of := [s for p, s in self.placed.values() if p == page])])
        return self.n + len(self.steps) - 1


#: Shapes of documents that a worker remembers.
SHAPES = 20_000


@lru_cache(SHAPES)
def plan(shape: str) -> tuple[list[tuple[int, str, int]], list[list[list[int]]]]:
    """What is inferred, as (page, figure id, number of its score), and of which scores each further one is made.

    shape: a document as JSON: p, its sheets; e, the expected ids; at and id, sheets and ids of its labels, by sheet and falling score.
    """
    x = json.loads(shape)
    placed: dict[Key, tuple[int, int]] = {}
    for i, (page, figure) in enumerate(zip(x.get("at", ()), x.get("id", ()))):
        placed.setdefault(key_of(figure), (page, i))
    ids = reconciled(set(x["e"]), {id_of(k) for k in placed})
    s = Traced(x["p"], placed, {key_of(i) for i in ids}, len(x.get("id", ())))
    for rule in RULES:
        s.place(list(rule(s)))
    return [(page, id_of(k), at) for page, k, at in s.guessed], s.steps


def with_inferred(figures: DataFrame, sheets: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, figure_id, page_index, score, method: the read labels and the inferred ones (method `sequence_inferred`).

    figures: doc_id, figure_id, page_index, score, method; sheets: doc_id,
    page_index; expected: doc_id, figure_id.
    """
    key = figures.schema["doc_id"].dataType.simpleString()
    label = F.struct(F.col("page_index").cast("int").alias("at"), (-F.col("score").cast("double")).alias("s"), F.col("figure_id").alias("id"))
    f = figures.where(figure_key(F.upper("figure_id")).isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(label)).alias("f"))
    p = sheets.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_index")).alias("p"))
    e = expected.groupBy("doc_id").agg(F.array_sort(F.collect_set("figure_id")).alias("e"))
    shape = F.to_json(F.struct("p", "e", F.col("f.at").alias("at"), F.col("f.id").alias("id")))
    rows = p.join(e, "doc_id").join(f, "doc_id", "left").select("doc_id", shape.alias("shape"), F.col("f.s").alias("s"))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, shape, scores in zip(b["doc_id"], b["shape"], b["s"]):
                found, steps = plan(shape)
                if not found:
                    continue
                values = [-s for s in scores.tolist()] if scores is not None else []
                for of in steps:
                    values.append(round(min(0.65, 0.65 * min((max(values[i] for i in page) for page in of), default=0.55)), 3))
                out += [(doc, figure, page, values[at], "sequence_inferred") for page, figure, at in found]
            yield pd.DataFrame(out, columns=["doc_id", "figure_id", "page_index", "score", "method"])

    new = rows.mapInPandas(guess, f"doc_id {key}, figure_id string, page_index int, score double, method string")
    return figures.select("doc_id", "figure_id", F.col("page_index").cast("int").alias("page_index"), F.col("score").cast("double").alias("score"), "method").unionByName(new)


#: Confidence up to which a label is doubtful if it names an expected figure, and if it does not.
DOUBTFUL, IMPOSSIBLE = 65.0, 85.0


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _covered(raw: dict, kept: list[dict]) -> bool:
    """Whether a kept label of the page stands on the same spot, or holds this one as a fragment of it."""
    plain = lambda t: re.sub("[^0-9A-Z]", "", t.upper())
    size = lambda b: max(0.0, b["x1"] - b["x0"]) * max(0.0, b["y1"] - b["y0"])
    a, mine = raw["box"], plain(raw["figure_id"])
    for k in kept:
        b, theirs = k["box"], plain(k["figure_id"])
        dx, dy = (a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2, (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2
        if (dx * dx + dy * dy) ** 0.5 <= 0.015:
            return True
        both = size({"x0": max(a["x0"], b["x0"]), "y0": max(a["y0"], b["y0"]), "x1": min(a["x1"], b["x1"]), "y1": min(a["y1"], b["y1"])})
        least = min(size(a), size(b))
        if least > 0 and both / least >= 0.8 and mine and theirs and (mine in theirs or theirs in mine):
            return True
    return False


def recovered(raw: list[dict], kept: list[dict], expected: set[str]) -> list[tuple[dict, str]]:
    """(raw label, figure id): doubtful labels that no kept one covers, read anew as figures missing between the sheets around.

    raw and kept: figure_id, page_index, box, confidence; raw: forms, what its id may stand for. On each sheet the
    pairs of least edit distance are taken first, each label and figure once; a
    label too far from every missing id stays out.
    """
    lettered = {k[0] for e in expected if (k := key_of(e)) and k[1]}
    want = {k for e in expected if (k := key_of(e)) and (k[1] or k[0] not in lettered)}
    known = {(k, x["page_index"]) for x in kept if (k := key_of(x["figure_id"]))}
    if not want or not known:
        return []
    out: list[tuple[dict, str]] = []
    doubtful: dict[int, list[tuple[dict, list[str]]]] = {}
    for x in raw:
        forms = x["forms"]
        limit = DOUBTFUL if any(key_of(f) in want for f in forms) else IMPOSSIBLE
        if (x["confidence"] or 0.0) <= limit and not _covered(x, [k for k in kept if k["page_index"] == x["page_index"]]):
            doubtful.setdefault(x["page_index"], []).append((x, forms))
    for page in sorted(doubtful):
        low = max((k for k, p in known if p < page), default=min(want))
        high = min((k for k, p in known if p > page), default=max(want))
        gone = sorted(k for k in want if low < k < high and all(k != q for q, _ in known))
        here = sorted(k for k, p in known if p == page)
        pairs = []
        for i, (x, forms) in enumerate(doubtful[page]):
            own, sides = key_of(x["figure_id"]), gone
            if own and here and (own < here[0] or own > here[-1]):
                sides = [k for k in gone if (k < here[0] if own < here[0] else k > here[-1])] or gone
            pairs += [(min(_edits(f, id_of(k)) for f in forms), i, gone.index(k)) for k in sides]
        labels, taken = set(), set()
        for distance, i, j in sorted(pairs):
            if i not in labels and j not in taken and distance <= max(3, len(id_of(gone[j])) // 2):
                labels.add(i)
                taken.add(j)
                out.append((doubtful[page][i][0], id_of(gone[j])))
                known.add((gone[j], page))
    return out


def with_recovered(raw: DataFrame, kept: DataFrame, expected: DataFrame) -> DataFrame:
    """kept and the labels read anew (method `spec_sequence_corrected`, score 0.52); all with doc_id, figure_id, page_index, box, confidence, score, method."""
    cols = ["figure_id", "page_index", "box", "confidence"]
    group = lambda df, name, c: df.groupBy("doc_id").agg(F.collect_list(c).alias(name))
    some = loose_ids(F.col("figure_id"))
    forms = F.when(F.size(some) > 0, some).otherwise(F.array(F.upper(F.regexp_replace("figure_id", r"\s", "")))).alias("forms")
    rows = group(raw, "r", F.struct(*cols, forms)).join(group(kept, "k", F.struct(*cols)), "doc_id").join(group(expected.distinct(), "e", F.col("figure_id")), "doc_id")
    schema = kept.select("doc_id", *cols, "score", "method").schema

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, r, k, e in zip(b["doc_id"], b["r"], b["k"], b["e"]):
                for x, figure in recovered([dict(x) for x in r], [dict(x) for x in k], set(e)):
                    out.append((doc, figure, x["page_index"], x["box"], x["confidence"], 0.52, "spec_sequence_corrected"))
            yield pd.DataFrame(out, columns=["doc_id", *cols, "score", "method"])

    return kept.select("doc_id", *cols, "score", "method").unionByName(rows.mapInPandas(read, schema))
