"""Selections, copies and small record keeping of a library: ranges, sets, quotes, page sets, inserts and one-time grants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized_figure

# Fixed value: addresses of private, local, shared and reserved networks.
PRIVATE = r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(22[4-9]|2[345][0-9])\."


def between(entries: DataFrame, first: Column, last: Column, order: str = "ordinal") -> DataFrame:
    """The entries from one to the other, whichever comes first."""
    return entries.where(F.col(order).between(F.least(first, last), F.greatest(first, last)))


def members(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in a set of chosen ones, each once."""
    return rows.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def corrected_count(entries: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines whose shown text differs from the source's."""
    return entries.groupBy(*keys).agg(F.count_if(F.col("display_text") != F.col("source_text")).alias("corrected"))


def flattened(text: Column) -> Column:
    """Copied text on one line: hyphens at line ends joined, white space single."""
    joined = F.regexp_replace(text, r"(\p{L})[-‐‑]\s*\n\s*(?=\p{L})", "$1")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def quoted(text: Column, citation: Column) -> Column:
    """The flattened text in quotes, and where it stands; nothing of an empty text."""
    t = flattened(text)
    return F.when(t != "", F.concat(F.lit("“"), t, F.lit("” ("), citation, F.lit(")")))


def blocks(text: Column) -> Column:
    """Paragraphs of a text that blank lines part, white space single, empty ones left out."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(parts, lambda x: x != "")


def figure_ids(parts: Sequence[DataFrame], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The distinct ids that any of the inputs names, in their normal form."""
    rows = None
    for p in parts:
        one = p.select(*keys, normalized_figure(F.col("figure_id")).alias("figure_id"))
        rows = one if rows is None else rows.union(one)
    return rows.where("figure_id <> ''").distinct()


def carried(rows: DataFrame, before: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """rows with the named fields of an earlier result wherever that has a value."""
    old = before.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return rows.join(old, list(keys), "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def by_key(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """keys, items: what each key has, in order."""
    items = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*keys).agg(F.transform(items, lambda x: x[value]).alias("items"))


def page_set(entries: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_set("page_index")).alias("pages"))


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of each key, and whether there were more; the cap is the feature."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumns({"_n": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "capped": n > most}).where(F.col("_n") <= most).drop("_n")


def page_url(base: Column, number: Column, language: str = "en") -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), number, F.lit(f"/{language}"))


def is_public_address(address: Column) -> Column:
    """An IPv4 address outside private, local, shared and reserved networks."""
    part = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.coalesce(address.rlike(rf"^{part}(\.{part}){{3}}$") & ~address.rlike(PRIVATE), F.lit(False))


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose key is not there yet; of several, the first by all columns."""
    w = Window.partitionBy(*keys).orderBy(*new.columns)
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def audit_rows(events: DataFrame, actor: str, action: str, target: str, at: str) -> DataFrame:
    """What an audit log takes of events: who, what, on which record and when, and nothing of the content."""
    return events.select(F.col(actor).alias("actor"), F.col(action).alias("action"), F.sha2(F.col(target).cast("string"), 256).alias("target"), F.col(at).alias("at"))


def committed_imports(imports: DataFrame, now: Column) -> DataFrame:
    """Imports that may be committed: not yet consumed, not run out, and, in version 1, confirmed."""
    fresh = F.col("consumed_at").isNull() & (F.col("expires_at") > now)
    return imports.where(fresh & ((F.col("schema_version") > 1) | F.coalesce(F.col("confirmed"), F.lit(False))))


def scaffold(entries: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, json: a label file to be filled in, one reference an entry, marked as not verified."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "ref"))), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["ref"].alias("ref")))
    per = entries.groupBy(*keys).agg(refs.alias("references"))
    return per.select(*keys, F.to_json(F.struct(*keys, "references", F.struct(F.lit(False).alias("verified")).alias("_scaffold"))).alias("json"))


def review_summary(suggestions: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: suggestions, those taken, and a warning where none was."""
    out = suggestions.groupBy(*keys).agg(F.count("*").alias("suggested"), F.count_if("taken").alias("taken"))
    return out.withColumn("warning", F.when(F.col("taken") == 0, "nothing_taken"))


def ready_sources(sources: DataFrame, checks: DataFrame) -> DataFrame:
    """Sources with the stored result of their last preflight; those without one are not ready."""
    w = Window.partitionBy("source_id").orderBy(F.desc("checked_at"), F.desc("ready"))
    last = checks.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("source_id", F.col("ready").alias("_r"))
    return sources.join(last, "source_id", "left").withColumn("ready", F.coalesce("_r", F.lit(False))).drop("_r")
