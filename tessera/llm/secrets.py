"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every candidate's value is hashed and counted over the corpus by distinct
repository and owner. Values that several owners, or many repositories, hold are
examples that were copied around; values of a single owner that stand in few of its
repositories and look random are live-looking. A table of documents that names no
repositories needs a stand-in: the query takes source as owner and source/lang as repository.
The plain patterns always report; the wide pattern (long mixed tokens without
a keyword) adds a span only where the frequencies say owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import row_key, texts, written

# The patterns of the base scan and the least length of what is measured.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_START = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: The added kind: long tokens that mix letters and digits.
WIDE, WIDE_LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
KINDS = ["assign", "access", "hex", "wide"]
#: Owners from which on a value counts as a widely copied example, and distinct characters that live-looking ones have.
EXAMPLE_OWNERS, LIVE_CHARACTERS = 3, 8
#: Repositories from which on a value counts as copied widely, whoever owns them, and up to which one owner's value is live-looking.
EXAMPLE_REPOSITORIES, LIVE_REPOSITORIES = 6, 2


def _pieces(text: Column, kind: str, pattern: str, needs: Column) -> Column:
    """Matches of pattern in order, each with the length of the text between it and the last one."""
    number = F.lit(KINDS.index(kind))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = F.transform(pairs, lambda x, i: F.struct(number.alias("kind"), i.alias("i"), F.length(x["before"]).alias("gap"), x["hit"].alias("hit")))
    return F.when(needs, F.filter(rows, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string>>"))


def may_hold(text: Column) -> Column:
    """Whether a text has a candidate of any kind, of whatever length."""
    return text.rlike(ASSIGN_START) | text.contains("AKIA") | text.rlike("[0-9a-f]{16}") | text.rlike(WIDE)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, repository, owner, kind, start, end, digest, mixed_up of every candidate; start and end in code points, end exclusive.

    digest is the value's, which itself goes no further; mixed_up tells whether it looks random.

    docs: doc_id, text, repository, owner. The places come from what stands
    between the matches, summed by a window over one row's matches of a kind.
    """
    t = F.col("text")
    # Runs of 16 or more are the maximal runs that pass; only rows that hold one are cut up.
    found = F.concat(
        _pieces(t, "assign", ASSIGN, t.rlike(ASSIGN_START)),
        _pieces(t, "access", ACCESS, t.contains("AKIA")),
        _pieces(t, "hex", r"[0-9a-f]{16,}", t.rlike(r"[0-9a-f]{16}")),
        _pieces(t, "wide", WIDE, t.rlike(WIDE)),
    )
    rows = docs.select("doc_id", row_key(t).alias("row_key"), "repository", "owner", F.explode(found).alias("m")).select("doc_id", "row_key", "repository", "owner", "m.*")
    once = rows.groupBy("doc_id", "row_key", "kind", "i").agg(F.first("gap").alias("gap"), F.first("hit").alias("hit"), F.min("repository").alias("repository"), F.min("owner").alias("owner"))
    w = Window.partitionBy("doc_id", "row_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(w)
    placed = once.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    long_enough = F.element_at(F.array(*[F.lit(n) for n in (*LEAST.values(), WIDE_LEAST)]), F.col("kind") + 1)
    mixed = (F.col("kind") < 3) | (F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[A-Za-z]"))
    kept = placed.withColumn("value", value).where((F.length("value") >= long_enough) & mixed)
    random = F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS
    return kept.select("doc_id", "row_key", "repository", "owner", "kind", "start", "end", F.sha2("value", 256).alias("digest"), random.alias("mixed_up"))


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_repositories, n_owners of every candidate value; counted over distinct pairs, so that no value's rows meet in one task."""
    pairs = found.groupBy("digest", "owner", "repository").count()
    owners = pairs.groupBy("digest", "owner").agg(F.count("*").alias("r"))
    return owners.groupBy("digest").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """Per row: doc_id, row_key, and found: array of (start, kind, end, example, live), by start, then kind.

    example: at least EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories
    hold the value; live: one owner does, in at most LIVE_REPOSITORIES
    repositories, and the value looks random. Spans of kind `wide` are there only if live and
    apart from all other spans of the row. A null text is empty; a null owner
    or repository is one of its own. Row in, row out: repeated rows each come
    out with the same spans and are one holder of their values. A row without
    spans has an empty array, an empty table gives no rows. Texts of any length are
    scanned whole; columns that are not named are not read. Equal starts come in the order of kinds.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), as_col(repository).cast("string").alias("repository"), as_col(owner).cast("string").alias("owner"))
    found = written(occurrences(docs), "secrets")
    shared = ownership(found)
    # Only values of one owner and few repositories, or copied widely, change anything; the join may split a hot digest's rows.
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    own = (F.col("n_owners") == 1) & (F.col("n_repositories") <= LIVE_REPOSITORIES)
    rated = found.join(shared.select("digest", copied.alias("copied"), own.alias("own")), "digest")
    live = F.col("own") & F.col("mixed_up")
    spans = rated.select("doc_id", "row_key", F.struct(F.col("start").cast("int").alias("start"), "kind", F.col("end").cast("int").alias("end"), F.col("copied").alias("example"), live.alias("live")).alias("s"))
    # A wide token must not touch another span: their furthest end so far and nearest start from here on say so.
    w = Window.partitionBy("doc_id", "row_key").orderBy("s.start", "s.kind")
    before = F.max(F.when(F.col("s.kind") < 3, F.col("s.end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("s.kind") < 3, F.col("s.start"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    apart = F.coalesce(before <= F.col("s.start"), F.lit(True)) & F.coalesce(after >= F.col("s.end"), F.lit(True))
    kept = spans.withColumn("apart", apart).where((F.col("s.kind") < 3) | (F.col("s.live") & F.col("apart")))
    by_row = kept.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list("s")).alias("found"))
    rows = docs.select("doc_id", row_key(F.col("text")).alias("row_key"))
    same = rows["doc_id"].eqNullSafe(by_row["doc_id"]) & (rows["row_key"] == by_row["row_key"])
    empty = F.array().cast(by_row.schema["found"].dataType)
    return rows.join(by_row, same, "left").select(rows["doc_id"], rows["row_key"], F.coalesce("found", empty).alias("found"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every stretch that spans cover replaced by [SECRET]; spans are sorted by start."""
    start = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        spans, start,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    shift = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), merged)
    pairs = F.arrays_zip(shift.alias("a"), merged.alias("b"))
    parts = F.transform(pairs, lambda p: F.when(p["b"].isNotNull(), F.concat(text.substr(p["a"]["end"] + 1, p["b"]["start"] - p["a"]["end"]), F.lit("[SECRET]"))).otherwise(text.substr(p["a"]["end"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = scan(docs, repository=F.concat_ws("/", "source", "lang"), owner="source")
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["example"])).cast("long").alias("n_example"), F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
    )
