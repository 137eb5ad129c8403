"""Provider pages: meta data, sections and paragraphs from HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Labels of dates by scheme, of other meta names, and the classes that make a div a paragraph.
DATE_LABELS = {"priority": "Priority date", "filing": "Filing date", "publication": "Publication date", "issue": "Issue date", "datesubmitted": "Submitted date"}
NAME_LABELS = {"citation_assignee": "Original assignee", "citation_priority_date": "Priority date", "citation_filing_date": "Filing date", "citation_publication_date": "Publication date"}
PEOPLE = {"dc.contributor", "citation_inventor", "citation_author"}
PARAGRAPH_CLASSES = {"description": {"description-line", "description-paragraph"}, "claims": {"claim", "claim-text"}, "abstract": {"abstract"}}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta"}

PROVIDER = StructType([
    *[StructField(n, StringType()) for n in ("canonical", "title", "description", "claims", "abstract")],
    StructField("metadata", ArrayType(StructType([StructField("label", StringType()), StructField("value", StringType())]))),
])


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of a name, whichever attribute comes first; null without one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: t.rlike(rf"(?i)\bname\s*=\s*[\"']{re.escape(name)}[\"']"))
    return F.nullif(F.regexp_extract(F.try_element_at(named, F.lit(1)), r"(?i)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def paragraphs(html: Column) -> Column:
    """Texts of the p elements, tags out and white space single."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(inner, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " "))), lambda p: p != "")


class _Page(HTMLParser):
    """One pass over a page: meta tags, and blocks of text of the sections named by itemprop."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.pairs: list[tuple[str, str]] = []
        self.sections: dict[str, list[str]] = {}
        self.loose: dict[str, list[str]] = {}
        self.inside: str | None = None
        self.stack: list[tuple[str, bool]] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k.lower(): (v or "").strip() for k, v in attrs}
        if tag == "meta" and a.get("content"):
            self._meta(a.get("name", "").lower(), a["content"], a.get("scheme", "").lower())
        if tag == "br" and self.text is not None:
            self.text.append(" ")
        if tag in VOID_TAGS:
            return
        if tag == "section" and not self.inside and a.get("itemprop", "").lower() in PARAGRAPH_CLASSES:
            self.inside = a["itemprop"].lower()
            self.sections.setdefault(self.inside, [])
            self.loose.setdefault(self.inside, [])
            self.stack = []
        block = bool(self.inside) and self.text is None and (tag in ("p", "li") or (tag == "div" and bool(set(a.get("class", "").lower().split()) & PARAGRAPH_CLASSES[self.inside])))
        if self.inside:
            self.stack.append((tag, block))
        if block:
            self.text = []

    def handle_endtag(self, tag):
        if not self.inside or tag in VOID_TAGS:
            return
        if self.stack and any(t == tag for t, _ in self.stack):
            while self.stack:
                t, block = self.stack.pop()
                if block:
                    if said := " ".join("".join(self.text or []).split()):
                        self.sections[self.inside].append(said)
                    self.text = None
                if t == tag:
                    break
        if tag == "section" and not self.stack:
            self.inside = None

    def handle_data(self, data):
        if self.inside:
            self.loose[self.inside].append(data)
        if self.text is not None:
            self.text.append(data)

    def _meta(self, name, content, scheme):
        for key, names in (("canonical", ("citation_patent_number",)), ("title", ("dc.title", "citation_title")), ("abstract", ("dc.description",))):
            if name in names and (key == "canonical" or key not in self.meta):
                self.meta[key] = content
        label = ("Original assignee" if "assignee" in scheme else "Inventor") if name in PEOPLE else DATE_LABELS.get(scheme) if name == "dc.date" else NAME_LABELS.get(name)
        if label and (label, content) not in self.pairs:
            self.pairs.append((label, content))

    def section(self, name: str) -> str:
        return "\n".join(self.sections.get(name) or [x for x in [" ".join(" ".join(self.loose.get(name, [])).split())] if x])


def read_page(html: str | None) -> dict | None:
    if html is None:
        return None
    p = _Page()
    p.feed(html)
    p.close()
    return {
        "canonical": p.meta.get("canonical"), "title": p.meta.get("title"), "description": p.section("description"), "claims": p.section("claims"),
        "abstract": " ".join((p.section("abstract") or p.meta.get("abstract", "")).split()), "metadata": [{"label": a, "value": b} for a, b in p.pairs],
    }


@F.pandas_udf(PROVIDER)
def provider_page(html: pd.Series) -> pd.DataFrame:
    """canonical, title, description, claims, abstract and meta data of a provider's page; paragraphs are lines."""
    return pd.DataFrame([read_page(h) or dict.fromkeys(("canonical", "title", "description", "claims", "abstract", "metadata")) for h in html], columns=["canonical", "title", "description", "claims", "abstract", "metadata"])


def numbered_paragraphs(text: Column) -> Column:
    """Lines of a text where only a numbered one (`(12) ...`) starts a paragraph; the others go on with the one before."""
    lines = F.filter(F.transform(F.split(text, r"\n|<br\s*/?>"), lambda x: F.trim(x)), lambda x: x != "")
    mark = r"^[\[(]\s*[0-9]{1,4}\s*[\])]\s*"
    empty = F.array().cast("array<string>")
    return F.aggregate(
        lines, empty,
        lambda acc, x: F.when(x.rlike(mark) | (F.size(acc) == 0), F.concat(acc, F.array(F.regexp_replace(x, mark, ""))))
        .otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), x)))),
    )


def clean_text(description: Column, claims: Column) -> Column:
    return F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(claims, F.lit("")))


def front_matter(pairs: Column) -> Column:
    """label -> values joined by `; ` in the order they came first; labels up to 80 and values up to 500 characters."""
    cut = F.transform(pairs, lambda p: F.struct(F.left(F.trim(p["label"]), F.lit(80)).alias("label"), F.left(F.trim(p["value"]), F.lit(500)).alias("value")))
    some = F.filter(cut, lambda p: (p["label"] != "") & (p["value"] != ""))
    labels = F.array_distinct(F.transform(some, lambda p: p["label"]))
    return F.transform(labels, lambda n: F.struct(n.alias("label"), F.array_join(F.array_distinct(F.transform(F.filter(some, lambda p: p["label"] == n), lambda p: p["value"])), "; ").alias("value")))


def best_source(rows, key: str, expected: str):
    """Of a provider's search results per key the one of the expected type, then a text source before a scanned one."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col("type") != expected, F.col("type") == "USOCR", "guid")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
