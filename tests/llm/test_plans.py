"""What the plans must and must not hold."""

from __future__ import annotations

import re

import pytest

from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_secrets", "op3_decontaminate", "op6_licenses"])
def test_native_queries_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op4_language_id", "op9_token_counts", "op10_toxicity"])
def test_scoring_does_not_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and "MapInArrow" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))


def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["op9_token_counts"](spark, SF))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_near_copies_are_named_once(spark, monkeypatch):
    """The filter's count, its filling and the join read one written table of ids, not the search's last joins each."""
    import corpus_pipeline
    from tessera.llm import bloom

    found = []
    plain = bloom.without

    def noted(df, id_col, drop, drop_col):
        found.append(drop._jdf.queryExecution().executedPlan().toString())
        return plain(df, id_col, drop, drop_col)

    monkeypatch.setattr(bloom, "without", noted)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, "other words", "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=repr)
    assert got == [1, 3, None]
    assert len(found) == 1 and "Join" not in found[0]
