"""String functions as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that stand for digits in recognised text.
OCR_LETTERS, OCR_DIGITS = "OolIiSsBZGg", "00111558266"
# Kind codes.
GRANT_KINDS, APPLICATION_KINDS, OTHER_KINDS = ["A", "B1", "B2"], ["A1", "A2", "A9"], ["S", "P", "P1", "P2", "P3", "E", "H"]
# How headings of a specification's parts begin, headings of one word, and how claims are introduced.
SPECIFICATION_HEADING = (
    r"(?i)^(?:field\s+of\s+the\s+invention|technical\s+field|background(?:\s+of\s+the\s+invention)?|summary(?:\s+of\s+the\s+invention)?|brief\s+description\s+of\s+the\s+drawings|description\s+of\s+the\s+drawings"
    r"|detailed\s+description|description\s+of\s+(?:the\s+)?(?:preferred\s+)?embodiments?|cross-reference\s+to\s+related\s+applications?|related\s+(?:art|applications?)|objects?\s+of\s+the\s+invention|abstract)"
)
ONE_WORD_HEADINGS = ["ABSTRACT", "CLAIMS", "BACKGROUND", "SUMMARY", "DRAWINGS"]
CLAIMS_START = r"(?i)^(?:claims?|what is claimed(?:\s+is)?|the invention claimed is|the invention is claimed as follows|the following is claimed|i claim|we claim)\b"


def normalized(text: Column) -> Column:
    """Lower case; everything but letters a-z, digits and spaces becomes a space; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def normalized_tokens(text: Column) -> Column:
    """Each white-space token normalised by itself, empty ones left out."""
    marked = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]+", "\x01")  # once over the text; what is left to do a token is cheap
    return F.filter(F.transform(F.split(marked, r"\s+"), lambda t: F.trim(F.translate(t, "\x01", " "))), lambda t: t != "")


def contains_text(text: Column, query: str) -> Column:
    """Case-insensitive substring; a blank query finds nothing."""
    q = query.strip().lower()
    return F.contains(F.lower(text), F.lit(q)) if q else F.lit(False)


def ocr_digits(text: Column) -> Column:
    """The 1 to 3 digits of a token, read as they are or after repair, else null."""
    raw = F.rtrim(F.trim(text), F.lit("."))
    fixed = F.translate(raw, OCR_LETTERS, OCR_DIGITS)
    return F.when(raw.rlike("^[0-9]{1,3}$"), raw).when(fixed.rlike("^[0-9]{1,3}$"), fixed)


def gutter_value(text: Column) -> Column:
    """A printed line number: a multiple of five from 5 to 70, else null."""
    n = ocr_digits(text).cast("int")
    return F.when((n % 5 == 0) & n.between(5, 70), n)


def paragraph_marker(text: Column) -> Column:
    """The 3 or 4 digits of a marker at the start of a line, else null."""
    m = F.regexp_extract(text, r"^[\[(]\s*([0-9]{3,4})\s*[\])]", 1)
    return F.nullif(m, F.lit(""))


def without_marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^[\[(]\s*[0-9]{3,4}\s*[\])]\s*", ""))


def grouped(number: Column) -> Column:
    return F.format_number(number.cast("bigint"), 0)


def grant_ref(column: Column, line: Column) -> Column:
    return F.concat_ws(":", column.cast("string"), line.cast("string"))


def locator_ref(kind: Column, column: Column, line: Column, paragraph: Column) -> Column:
    """`c:l` of a grant line, `[pppp]` of an application paragraph."""
    return F.when(kind == "grant", grant_ref(column, line)).otherwise(F.concat(F.lit("["), paragraph, F.lit("]")))


def parse_ref(text: Column) -> Column:
    """column and line of a `c:l` reference, both positive, else null."""
    pattern = r"^\s*([0-9]{1,9})\s*:\s*([0-9]{1,9})\s*$"
    c, n = (F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), F.lit(1)).cast("int") for i in (1, 2))
    return F.when((c > 0) & (n > 0), F.struct(c.alias("column"), n.alias("line")))


def canonical_id(value: Column) -> Column:
    """Letters and digits in upper case without a kind code."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]", "")), "[A-Z][0-9]?$", "")


def parse_identifier(raw: Column) -> Column:
    """struct(ok, reason, doc_type, number, kind, canonical, display) of a patent number as people write it."""
    up = F.upper(F.trim(raw))
    s = F.regexp_replace(up, r"^U\.?\s*S\.?", "")
    s = F.regexp_replace(F.regexp_replace(s, r"PATENT|PUB(LICATION)?|APP(LICATION)?|NO\.?|#", ""), r"[\s,./]", "")
    number = F.regexp_extract(s, r"^([0-9]+)([A-Z][0-9]?)?$", 1)
    kind = F.nullif(F.regexp_extract(s, r"^([0-9]+)([A-Z][0-9]?)?$", 2), F.lit(""))
    application = F.coalesce(kind.isin(APPLICATION_KINDS), F.lit(False)) | (kind.isNull() & F.contains(up, F.lit("/")))
    grant = ~application & (kind.isNull() | kind.isin(GRANT_KINDS))
    reason = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty")
        .when(number == "", "unrecognized")
        .when(F.coalesce(kind.isin(OTHER_KINDS), F.lit(False)), "unsupported_kind")
        .when(application & (F.length(number) != 11), "invalid_number")
        .when(grant & ~F.length(number).between(4, 8), "ambiguous")
        .when(~application & ~grant, "unsupported_kind")
    )
    used = F.when(application, F.coalesce(kind, F.lit("A1"))).otherwise(kind)
    shown = F.when(application, F.concat_ws("/", F.substring(number, 1, 4), F.substring(number, 5, 7))).otherwise(F.when(F.length(number).between(4, 8), grouped(F.when(F.length(number).between(4, 8), number))))
    ok = reason.isNull()
    return F.struct(
        ok.alias("ok"), reason.alias("reason"), F.when(ok, F.when(application, "application").otherwise("grant")).alias("doc_type"),
        F.when(ok, number).alias("number"), F.when(ok, used).alias("kind"),
        F.when(ok, F.concat(F.lit("US"), number, F.coalesce(used, F.lit("")))).alias("canonical"),
        F.when(ok, F.concat_ws(" ", F.lit("US"), shown, used)).alias("display"),
    )


def dehyphenated(text: Column) -> Column:
    """A word that a hyphen and a line break part is one word."""
    return F.regexp_replace(text, r"(\p{L})[-‐‑]\s*\n\s*(?=\p{L})", "$1")


def wrapped(text: Column, width: int) -> Column:
    """Printed lines of a text: as many words as fit width letters each, a longer word by itself."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{width - 1}}}(?!\S)|\S+"), F.lit(0))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references, named and numbered, as the characters; null stays null."""
    return text.map(html.unescape, na_action="ignore")


def stripped_html(markup: Column) -> Column:
    """Tags become spaces, character references their characters, white space single. Only texts with a reference go to Python."""
    t = F.regexp_replace(markup, "<[^>]*>", " ")
    t = F.coalesce(unescaped(F.when(F.contains(t, F.lit("&")), t)), t)
    return F.trim(F.regexp_replace(t, r"[\s\x{A0}]+", " "))


def clean_string(text: Column, limit: int) -> Column:
    """No NUL characters, trimmed, null if nothing is left, at most limit characters."""
    return F.left(F.nullif(F.trim(F.replace(text, F.lit("\x00"), F.lit(""))), F.lit("")), F.lit(limit))


def figure_key(figure_id: Column) -> Column:
    """struct(number, suffix 0 to 26): the natural order of figure ids; null if it is none."""
    n = F.regexp_extract(figure_id, "^([0-9]+)([A-Za-z]?)$", 1)
    s = F.upper(F.regexp_extract(figure_id, "^([0-9]+)([A-Za-z]?)$", 2))
    return F.when(n != "", F.struct(n.cast("int").alias("number"), F.when(s == "", 0).otherwise(F.ascii(s) - 64).alias("suffix")))


def normalized_figure(figure_id: Column) -> Column:
    """Without `fig.` or `figure`, without spaces, in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(figure_id, r"(?i)^\s*fig(ure)?s?\.?\s*", ""), r"\s+", ""))


def confusion_fixed(text: Column, drawing: bool = False) -> Column:
    """Letters that are often misread for digits, as those digits; drawing has more of them."""
    plain = ("ILOQSBZ", "1100582")
    more = ("ILOQSBZ|WF", "1100582117")
    return F.translate(F.upper(text), *(more if drawing else plain))


def is_year(text: Column) -> Column:
    return text.rlike("^(19|20)[0-9]{2}$")


def is_bold_font(name: Column) -> Column:
    """Null without a name."""
    return F.when(F.trim(name) != "", F.lower(name).rlike("bold|black|heavy|demi"))


def is_sheet_header(text: Column) -> Column:
    return F.lower(text).rlike(r"sheet\s+[0-9]+\s+(?:of|/)\s+[0-9]+")


def _capitals(t: Column) -> Column:
    return (F.upper(t) == t) & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 3)


def is_heading(text: Column) -> Column:
    """A line in capitals of two to eight words, or one of the known single words."""
    t = F.trim(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return _capitals(t) & t.rlike(r"^[A-Z][A-Z0-9 ,.'()\-/&]{3,58}$") & F.when(words >= 2, words <= 8).otherwise(t.isin(ONE_WORD_HEADINGS))


def is_heading_part(text: Column) -> Column:
    """A line in capitals that may be part of a heading over several lines."""
    t = F.trim(text)
    return _capitals(t) & t.rlike(r"^[A-Z][A-Z0-9 ,.'()\-/&]{2,80}$")


def claim_candidate(text: Column) -> Column:
    """The number that starts a claim (`12. A device`, `12.A device` or `12.` alone), not a decimal; else null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^([0-9]{1,3})\s*\.(?:\s+|$|(?=[A-Za-z(]))", 1), F.lit("")).cast("int")


def short_name(display: Column) -> Column:
    """The last three digits of the longest number, as in ’427 patent; the first of equally long ones. Without three digits, the text itself."""
    runs = F.transform(F.regexp_extract_all(display, F.lit("[0-9][0-9,./-]*"), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    best = F.try_element_at(F.array_sort(F.transform(runs, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), F.lit(1))["x"]
    return F.when(F.length(best) >= 3, F.concat(F.lit("’"), F.right(best, F.lit(3)), F.lit(" patent"))).otherwise(display)


# Presets of a citation: (with the short name, colon form, word for column, for line, for lines, for a paragraph, for paragraphs).
CITATIONS = {
    "column-line": (True, True, "col.", "l.", "ll.", "¶", "¶¶"),
    "standard": (True, False, "col.", "l.", "ll.", "¶", "¶¶"),
    "verbose": (True, False, "column", "line", "lines", "paragraph", "paragraphs"),
    "compact": (False, True, "c.", "l.", "ll.", "para.", "para.s"),
}


def citation(first_column: Column, first_line: Column, last_column: Column, last_line: Column, preset: str = "column-line") -> Column:
    """Where a passage of a grant stands."""
    _, colon, col, line, lines, *_ = CITATIONS[preset]
    same = first_column == last_column
    one = same & (first_line == last_line)
    a, b, c, d = (x.cast("string") for x in (first_column, first_line, last_column, last_line))
    if colon:
        return F.when(one, F.concat(a, F.lit(":"), b)).when(same, F.concat(a, F.lit(":"), b, F.lit("-"), d)).otherwise(F.concat(a, F.lit(":"), b, F.lit("-"), c, F.lit(":"), d))
    at = lambda x, w, y: F.concat(F.lit(f"{col} "), x, F.lit(f", {w} "), y)
    return F.when(one, at(a, line, b)).when(same, F.concat(at(a, lines, b), F.lit("–"), d)).otherwise(F.concat(at(a, line, b), F.lit(" – "), at(c, line, d)))


def paragraph_citation(first: Column, last: Column, preset: str = "column-line") -> Column:
    """Where a passage of an application stands: `¶ [0012]`, `¶¶ [0012]–[0014]`."""
    *_, one, many = CITATIONS[preset]
    return F.when(first == last, F.concat(F.lit(f"{one} ["), first, F.lit("]"))).otherwise(F.concat(F.lit(f"{many} ["), first, F.lit("]–["), last, F.lit("]")))


def full_citation(ref: Column, number: Column, preset: str = "column-line") -> Column:
    """The reference after the short name, if the preset has one and there is a number."""
    return F.when((ref != "") & F.lit(CITATIONS[preset][0]) & F.coalesce(number != "", F.lit(False)), F.concat_ws(" ", short_name(number), ref)).otherwise(ref)


def safe_name(text: Column, fallback: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot and dash become one underscore."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), fallback)


def conservative_edit(before: Column, after: Column) -> Column:
    """At most max(2, 8 %) tokens and max(12, 10 %) characters longer or shorter."""
    tokens = lambda t: F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != ""))
    n, m = tokens(before), tokens(after)
    c, d = F.length(before), F.length(after)
    eighth, tenth = F.floor(n * 8 / 100), F.floor(c * 10 / 100)
    return (F.abs(m - n) <= F.greatest(F.lit(2), eighth)) & (F.abs(d - c) <= F.greatest(F.lit(12), tenth))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, and a host of the list."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts), F.lit(False))


def deep_link(doc: Column, first: Column, last: Column) -> Column:
    lo, hi = F.least(first, last).cast("string"), F.greatest(first, last).cast("string")
    return F.concat(F.lit("#doc="), doc.cast("string"), F.lit("&line="), F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("-"), hi)))


def parse_deep_link(link: Column) -> Column:
    """struct(doc, first, last), ends in order; null parts if they are not there."""
    line = F.regexp_extract(link, r"[#&]line=([0-9]+)(?:-([0-9]+))?", 1)
    end = F.regexp_extract(link, r"[#&]line=([0-9]+)(?:-([0-9]+))?", 2)
    a = F.nullif(line, F.lit("")).cast("int")
    b = F.coalesce(F.nullif(end, F.lit("")).cast("int"), a)
    return F.struct(F.nullif(F.regexp_extract(link, "[#&]doc=([^&]+)", 1), F.lit("")).alias("doc"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))
