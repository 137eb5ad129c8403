"""Every query against its SQL on the small tables, and the contract of the entry module."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.plans import documents, everyday, flows, reading, relational
from tessera.streaming import live

SF = "/root/testdata/sf0.001"
SQL = {**relational.SQL, **documents.SQL, **reading.SQL, **everyday.SQL, **flows.SQL}
QUERIES = {**relational.QUERIES, **documents.QUERIES, **reading.QUERIES, **everyday.QUERIES, **flows.QUERIES}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(float(f"{v[i]:.9g}") if isinstance(v[i], float) and math.isfinite(v[i]) else v[i] for i in order) for v in values]
    return sorted(names), sorted(flat, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["callout_choice", "callout_match_greedy", "column_split", "figure_inference", "figure_sequence", "page_routing", "word_dedupe_greedy"])
def test_all_orders_are_read(spark, tmp_path, name):
    """Orders of large ids give the rows that the same orders give under small ids."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 60")
    li.unionByName(li.withColumn("l_orderkey", (F.col("l_orderkey") + 60_000).cast(li.schema["l_orderkey"].dataType))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    at = got.columns.index("doc_id")
    found = [tuple(r) for r in got.collect()]
    low = sorted((r for r in found if r[at] < 60_000), key=repr)
    high = sorted((r[:at] + (r[at] - 60_000,) + r[at + 1 :] for r in found if r[at] >= 60_000), key=repr)
    assert low == high and low


def test_whole_titles_are_compared(spark, tmp_path):
    spark.createDataFrame([(3, "a title of 22 letters " + " " * 40 + "and many more words after that"), (6, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in documents.identity_verdict(spark, str(tmp_path)).collect()} == {(3, "insufficient"), (6, "probable")}


def test_whole_texts_are_imported(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(documents.P, "analyzed", lambda df, key: seen.extend(r["json"] for r in df.collect()) or (df.selectExpr(key, "'' as reason", "'' as doc_type", "0 as n_entries"), None))
    spark.createDataFrame([(7, "a text of more than twenty letters")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.import_validate(spark, str(tmp_path))
    assert '"a text of more than twenty lettersx"' in seen[0]


def test_the_stream_of_claims_is_the_batch(spark):
    whole = live.claims(flows.queue_log(spark.read.parquet(f"{SF}/events.parquet")).drop("at"), 60_000)
    got, want = ({tuple(r) for r in df.collect()} for df in (QUERIES["queue_claims"](spark, SF), whole))
    assert got >= want and all(r[3] == "expire" for r in got - want)  # the last leases run out as the stream ends


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
