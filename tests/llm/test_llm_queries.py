"""The named queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
import llm_brute as brute
from gradeloom.llm import queries
from oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_its_statement(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), name, queries.QUERIES[name], queries.SQL[name], sf_dir) is None


def rows(sf_dir, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{table}.parquet'").fetchall()


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    got = queries.QUERIES["op2_minhash"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near(rows(sf_dir, "documents", "doc_id, text")))


def test_repeats_equal_brute_force(spark, sf_dir):
    got = queries.QUERIES["op6_suffix_array"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeats(rows(sf_dir, "documents", "doc_id, text")))


def test_embeddings_equal_brute_force(spark, sf_dir):
    got = queries.QUERIES["op9_embeddings"](spark, sf_dir).collect()
    want = brute.vectors(rows(sf_dir, "embeddings", "vec_id, embedding"))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["op1_extract_html", "op4_lm_score", "op8_quality"])
def test_row_for_every_input_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op1") else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == len(rows(sf_dir, table, "1"))


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Every stage against a restatement of its rule on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert set(columns) <= set(after.columns)
        seen[name] = before.select("doc_id", "text").collect(), after.select("doc_id", "text").collect()
        before = after
    old, new = seen["quality"]
    labels = dict(rows(sf_dir, "labels", "doc_id, quality"))
    kept = {r[0] for r in new}
    good = [d for d, _ in old if labels.get(d) == 1]
    assert sum(d in kept for d in good) >= 0.9 * len(good)
    old, new = seen["near_duplicates"]
    want = {c for _, _, c, _ in brute.near(list(map(tuple, old)), corpus_pipeline.NEAR_PERCENT)}
    assert {r[0] for r in new} == want and len(new) == len(want)
    old, new = seen["repeats"]
    want = {d: n - gone for d, n, gone, _, _ in brute.repeats(list(map(tuple, old)))}
    assert all(0 <= want[d] - len(t.encode()) <= 6 * t.count(" ") + 40 for d, t in new) and len(new) == len(old)
    old, new = seen["benchmark"]
    bad = {r[0] for r in brute.leaks(list(map(tuple, old)), rows(sf_dir, "benchmark", "item_id, text")) if r[5]}
    assert {r[0] for r in new} == {r[0] for r in old} - bad
    old, new = seen["mix"]
    assert {r[0] for r in new} <= {r[0] for r in old}
    size = sum(len(t.split()) for _, t in old)
    assert 1.2 * size < sum(len(t.split()) for _, t in new) < 1.8 * size
