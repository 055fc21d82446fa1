"""The registered queries over whole small tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES = {k: q for k, q in entry_module.queries().items() if re.match(r"op\d+_", k)}
ORACLES = entry_module.oracle_sql()


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert "pipeline" in entry_module.queries()


@pytest.mark.parametrize("name", [name for name in QUERIES if not name.startswith(("op11_", "op12_"))])
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows, wanted = ([tuple(map(str, r)) for r in found] for found in (got.select(*columns).collect(), want.fetchall()))
    assert sorted(rows) == sorted(wanted)


def test_model_scores_held_out_texts_better_than_the_base(spark):
    held = QUERIES["op2_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out")
    score, base = held.groupBy().sum("score", "base_score").first()
    assert score > base
