"""License scan by canonical digests, in DataFrame operations only.

A text is normalised (case, punctuation, copyright lines, equivalent
spellings) and hashed whole; the digest is looked up among those of known
licence texts. Besides whole documents, each line of one is looked up too, as short notices stand on a line of their own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import row_key

# Spellings that count as equal, in the order in which they are replaced.
SPELLINGS = [
    ("licence", "license"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("http www", "https www"),
    ("http unlicense", "https unlicense"),
    ("sub license", "sublicense"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("recognise", "recognize"),
    ("authorise", "authorize"),
    ("per cent", "percent"),
]

#: Whole licence texts: files named after the SPDX id, up to a second dot (variants of one licence).
TEXTS = Path(__file__).with_name("license_texts")
# What a text may be headed with, by id.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "0BSD": "BSD Zero Clause License"}
# Notices of one line.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Ids without a text here that are known by their SPDX line alone.
SPDX_ONLY = ["AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0", "WTFPL"]


def known_texts() -> list[tuple[str, str]]:
    """(id, text) of all known licences: whole texts, with and without their titles, notices, and SPDX lines with the usual suffixes."""
    files = [(re.sub(r"\.(holder\.)?txt$", "", f.name), f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    titled = [(i, f"{TITLES[i]}\n{t}") for i, t in files if i in TITLES]
    ids = sorted({i for i, _ in files} | set(SPDX_ONLY))
    lines = [(i, f"SPDX-License-Identifier: {i}{suffix}") for i in ids for suffix in (["", "-only", "-or-later"] if "GPL" in i or "GFDL" in i else [""])]
    return files + titled + NOTICES + lines


#: Known digests up to which the lookup is a broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

COPYRIGHT_LINE = r"^[\s#*/;%-]*(copyright|\(c\)|©)"


def normal_lines(text: Column) -> Column:
    """Canonical form of each line, in order; copyright lines and empty ones are left out."""

    def one(line: Column) -> Column:
        x = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
        for a, b in SPELLINGS:
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return F.filter(F.transform(lines, one), lambda x: x != "")


def digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest, n_chars of normalised known texts; where several licences share a text, the first by name has it."""
    t = spark.createDataFrame(known_texts() if known is None else list(known), "license_id string, text string").select("license_id", normal_lines(F.col("text")).alias("lines"))
    return t.where(F.size("lines") > 0).select("license_id", digest(F.col("lines")).alias("digest"), F.length(F.array_join("lines", " ")).alias("n_chars")).groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("n_chars").alias("n_chars"))


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest of the whole text, text_license (null if unknown), n_notices (lines that are known texts), licenses (all ids, sorted, comma-joined).

    A null text is empty, has the digest of nothing and no licence. Row in, row
    out: repeated rows each come out alike, a null doc_id stays null; columns
    other than id and text are not read, whatever their names. Texts of any length
    are hashed whole. An empty table gives no rows. known is broadcast up to
    BROADCAST_ROWS rows.
    """
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.max("n_chars"), F.lit(0)).alias("longest")).first()
    table = known.select("digest", "license_id")
    table = F.broadcast(table) if size["n"] <= BROADCAST_ROWS else table
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lined = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), normal_lines(F.col("text")).alias("lines"))
    # No line longer than every known text can be one of them.
    short = F.filter("lines", lambda x: F.length(x) <= size["longest"])
    whole = F.col("whole")
    units = lined.select("doc_id", "row_key", digest(F.col("lines")).alias("whole"), short.alias("short")).select(
        "doc_id", "row_key", "whole", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("texts"), whole.alias("digest"))), F.transform("short", lambda x: F.struct(F.lit(0).alias("texts"), F.sha2(x, 256).alias("digest"))))).alias("u")
    )
    hits = units.select("doc_id", "row_key", "whole", "u.*").join(table, "digest", "left")
    by_license = hits.groupBy("doc_id", "row_key", "whole", "license_id").agg(F.sum("texts").alias("texts"), F.sum(1 - F.col("texts")).alias("lines"))
    by_row = by_license.groupBy("doc_id", "row_key", "whole").agg(
        F.max(F.when(F.col("texts") > 0, F.col("license_id"))).alias("text_license"),
        F.sum(F.when(F.col("license_id").isNotNull(), F.col("lines")).otherwise(0)).alias("lines"),
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("licenses"),
        F.sum("texts").alias("times"),
    )
    # times: how often the same row is in the table; its lines were counted as often.
    n_notices = F.expr("lines div times").alias("n_notices")
    return by_row.select("doc_id", whole.alias("digest"), "text_license", n_notices, "licenses", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_")).drop("_")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def _sql_normal(text: str) -> str:
    out = r"trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"list_filter(list_transform(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT regexp_matches(x, '{COPYRIGHT_LINE}')), lambda x: {out}), lambda x: x <> '')"


def sql(known: Sequence[tuple[str, str]] | None = None) -> str:
    rows = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in r)) for r in (known_texts() if known is None else known))
    return f"""
WITH k0(license_id, text) AS (VALUES {rows}),
k AS (SELECT sha256(array_to_string({_sql_normal("text")}, ' ')) AS digest, min(license_id) AS license_id FROM k0 GROUP BY 1),
d AS (SELECT doc_id, {_sql_normal("coalesce(text, '')")} AS lines FROM documents),
n AS (SELECT doc_id, lines, sha256(array_to_string(lines, ' ')) AS digest FROM d),
u AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, sha256(unnest(lines)) AS digest FROM n),
h AS (SELECT doc_id, i, license_id FROM u JOIN k USING (digest)),
a AS (SELECT doc_id, i, license_id FROM h UNION ALL SELECT doc_id, NULL, license_id FROM n JOIN k USING (digest)),
g AS (SELECT doc_id, count(DISTINCT i) AS n_notices, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS licenses FROM a GROUP BY doc_id)
SELECT n.doc_id, n.digest, k.license_id AS text_license, coalesce(g.n_notices, 0) AS n_notices, coalesce(g.licenses, '') AS licenses
FROM n LEFT JOIN k USING (digest) LEFT JOIN g ON g.doc_id = n.doc_id
"""
