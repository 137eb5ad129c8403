from __future__ import annotations

import random

import duckdb

from tessera.operators.near import near_texts
from tessera.plans import relational


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_near_pair_is_missed(spark):
    rng = random.Random(7)
    texts = {"".join(rng.choice("ab é") for _ in range(rng.randint(0, 13))) for _ in range(150)} | {"hot ring", "hot rings", "cold ring", "old ring"}
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "t string")
    for most in (1, 4):
        got = sorted(tuple(r) for r in near_texts(df, "t", most).collect())
        assert got == sorted((a, b, d) for a in texts for b in texts if (d := edits(a, b)) <= most)


def test_near_names_of_any_brand_size_and_type_are_paired(spark, tmp_path):
    rows = [(1, "hot ring", "B1", "T1", 1), (2, "old ring", "B2", "T2", 2), (3, "hot ring", "B2", "T1", 3), (4, "a large widget", "B1", "T1", 1), (5, None, "B1", "T1", 1), (6, "hot rings", None, None, None), (6, "hot rings", "B1", "T1", 1), (None, "hot ring", "B1", "T1", 1)]
    path = f"{tmp_path}/part.parquet"
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(path)
    got = sorted((tuple(r) for r in relational.edit_distance_pairs(spark, str(tmp_path)).collect()), key=repr)
    assert {(r[1], r[2]) for r in got} == {(1, 2), (1, 3), (1, 6), (2, 3), (2, 6), (3, 6)}
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{path}/*.parquet'")
    assert got == sorted(duck.execute(relational.SQL["edit_distance_pairs"]).fetchall(), key=repr)
