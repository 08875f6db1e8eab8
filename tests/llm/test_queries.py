import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import queries

TABLES = "documents pages labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert cols == sorted(want.columns)
    rows = duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_all_rows(spark, sf, name):
    key = "pages" if name.startswith("op5") else "documents"
    assert queries.queries()[name](spark, sf).count() >= spark.read.parquet(f"{sf}/{key}.parquet").count()


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "lines":
            assert after.count() == before.count()
        if name == "near_copies":
            assert after.count() == queries.simhash.components(before).select("component_id").distinct().count()
        before = after
    packed = before.collect()
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 for x in by.values())
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
