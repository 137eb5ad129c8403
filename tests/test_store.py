from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.operators import navigation as N
from tessera.sources import files, html
from tessera.sources import portable as P
from tessera.streaming import jobs as J


def test_import_reasons(spark):
    good = {"page_index": 0, "source_text": "x", "locator": {"kind": "grant", "column": 1, "printed_line": 2}}
    deep: list = []
    for _ in range(70):
        deep = [deep]
    cases = {
        "ok": {"schema_version": 2, "entries": [good], "bookmarks": [{"ref": "1:2", "label": " a "}, {"entry_index": 9}]}, "list": [], "version": {"schema_version": True, "entries": [good]}, "empty": {"schema_version": 2, "entries": []},
        "none": {"schema_version": 2, "entries": 5}, "bool": {"schema_version": 2, "entries": [{**good, "page_index": True}]}, "box": {"schema_version": 2, "entries": [good, {**good, "box": [0, 0, 0, 1]}]},
        "first": {"schema_version": 2, "entries": [{**good, "locator": {}}, {**good, "source_text": " "}]}, "deep": {"schema_version": 2, "entries": [good], "x": deep}, "marks": {"schema_version": 2, "entries": [good], "bookmarks": 3},
        "mixed": {"schema_version": 2, "entries": [good, {**good, "locator": {"kind": "application", "paragraph": "0001"}}]}, "old": {"schema_version": 1, "entries": [{"page_index": 0, "source_text": "y", "ref": "3:4"}]},
    }
    saves = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("broken", "{"), ("null", None)], "path string, json string")
    f, e = P.analyzed(saves)
    got = {r["path"]: r for r in f.collect()}
    want = {"ok": None, "list": "invalid_json", "version": "unsupported_schema", "empty": "empty", "none": "invalid_structure", "bool": "invalid_entry", "box": "invalid_box", "first": "invalid_locator", "deep": "too_deep", "marks": "invalid_structure", "mixed": None, "old": None, "broken": "invalid_json", "null": "too_large"}
    assert {k: r["reason"] for k, r in got.items()} == want
    assert got["mixed"]["doc_type"] == "grant" and "mixed_locators" in got["mixed"]["warnings"] and got["old"]["needs_migration"]
    resolved, dropped = P.bookmarks(saves, e)
    assert [(r["path"], r["entry_id"], r["label"]) for r in resolved.collect()] == [("ok", "line_0000000", "a")] and dropped.count() == 1


def test_provider_page(spark):
    page = '<meta content="US1234567B2" name="citation_patent_number"><meta name="DC.title" content="A &amp; B"><meta name="citation_inventor" content="Ann"><section itemprop="description"><div><p>One<br>two</p><p> </p><li>three</li></div></section><section itemprop="claims">1. A thing</section>'
    got = spark.createDataFrame([(page,), (None,)], "h string").select(html.provider_page("h").alias("p"), html.meta(F.col("h"), "citation_patent_number").alias("m")).collect()
    p = got[0]["p"]
    assert (p["canonical"], p["title"], p["description"], p["claims"]) == ("US1234567B2", "A & B", "One two\nthree", "1. A thing")
    assert [tuple(x) for x in p["metadata"]] == [("Inventor", "Ann")] and got[0]["m"] == "US1234567B2"


def test_marks_and_claims(spark):
    e = spark.createDataFrame([("d", 1, "abcdef")], "doc_id string, ordinal int, text string")
    s = spark.createDataFrame([("d", 1, 1, 4, "a"), ("d", 1, 2, 6, "b")], "doc_id string, ordinal int, start int, end int, name string")
    got = [(r["start"], r["end"], r["names"]) for r in N.marks(e, s, ["doc_id", "ordinal"]).orderBy("start").collect()]
    assert got == [(0, 1, []), (1, 2, ["a"]), (2, 4, ["a", "b"]), (4, 6, ["b"])]
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([3, 1, 2, 3, 7])], "doc_id string, ordinal int, number int")
    assert [r["number"] for r in N.backward_claims(rows).orderBy("ordinal").collect()] == [1, 2, 3]
    assert [r["number"] for r in N.claims(rows).orderBy("ordinal").collect()] == [1, 2, 3]


def test_chunks(spark):
    t = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([1500, 400, 300, 2500, 10])], "doc_id string, ordinal int, text string")
    assert [r["chunk"] for r in N.chunks(t, ["doc_id"], "ordinal", 100).orderBy("ordinal").collect()] == [0, 0, 1, 2, 3]


def test_tsv_words(spark):
    p = spark.createDataFrame([("d", 0, 100.0, 200.0, [5, 5, 4, 5], ["a", " ", "b", "c"], [90.0, 90.0, 90.0, 10.0], [10.0] * 4, [20.0] * 4, [30.0] * 4, [10.0] * 4, [1] * 4, [1] * 4, [1] * 4)], "doc_id string, page_index int, page_width double, page_height double, " + files.TSV)
    assert [(r["text"], r["x0"], r["y1"]) for r in files.words_from_tsv(p, 30.0).collect()] == [("a", 0.1, 0.15)]


def test_labels_and_artifacts(spark, tmp_path):
    for name, extra in (("a", {}), ("b", {"_scaffold": {"verified": False}}), ("c", {"_scaffold": {"verified": True}}), ("d", {"_scaffold": {}}), ("example", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"doc_id": name, **extra}))
    assert [r["doc_id"] for r in files.read_labels(spark, str(tmp_path)).collect()] == ["a", "c"]
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "x.json").write_text(json.dumps({"artifact_id": "x", "source_id": "s"}))
    assert files.read_artifacts(spark, str(tmp_path / "art")).first()["entries"] == []


def test_job_states(spark):
    ev = spark.createDataFrame([("a", 1, "claim"), ("a", 2, "succeed"), ("a", 3, "cancel"), ("b", 1, "cancel"), ("b", 2, "retry"), ("c", 1, "succeed")], "job_id string, seq long, event string")
    assert {r["job_id"]: r["state"] for r in J.final_states(ev).collect()} == {"a": "succeeded", "b": "queued", "c": "queued"}


def test_streams(spark, tmp_path):
    ev = [("a", 1, "claim"), ("a", 2, "succeed"), ("b", 1, "cancel")]
    spark.createDataFrame(ev, "job_id string, seq long, event string").write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("job_id string, seq long, event string").json(str(tmp_path / "in"))
    q = J.live_states(s).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["job_id"]: r["state"] for r in spark.table("states").collect()} == {"a": "succeeded", "b": "cancelled"}


def test_upsert_and_sampling(spark):
    old = spark.createDataFrame([("s", None, 1), ("s", 2, 1)], "k string, p int, v int")
    new = spark.createDataFrame([("s", None, 5)], "k string, p int, v int")
    assert sorted((r["p"] or 0, r["v"]) for r in files.upserted(old, new, ["k", "p"]).collect()) == [(0, 5), (2, 1)]
    ten = spark.range(10)
    assert sorted(r["id"] for r in L.evenly_sampled(ten, ["id"], 4).collect()) == [int(i * 10 / 4) for i in range(4)]
