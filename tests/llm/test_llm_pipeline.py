"""The stages of the pipeline on awkward tables, and what they leave behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import mixing, quality
from gradeloom.llm.common import split

CLASHES = ("text_hash", "_n", "rows", "copies", "copy", "_row", "place", "root", "kept", "score", "predicted", "bucket", "_copy")


def awkward(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "web", 0), (9003, " \n", "en", "web", 2),
         (9004, "long " * 30_000, "en", "web", 150_000), (9005, "short", None, None, 5), (9005, "short", None, None, 5)],
        "doc_id long, text string, lang string, source string, n_chars int",
    )
    both = docs.unionByName(odd.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    own = F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.substring("text", 1, 50)))
    return both.withColumns({c: F.concat(F.lit(c), own) for c in CLASHES})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, sf_dir, tmp_path, name, stage):
    awkward(spark, sf_dir).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    out = stage(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == (["copy_"] if name == "mix" else [])
    rows = out.collect()
    key = lambda r: tuple(r[c] for c in ("doc_id", "lang", "source", *CLASHES))
    known = {key(r) for r in docs.collect()}
    assert {key(r) for r in rows} <= known and all(r[c].startswith(c) for r in rows for c in CLASHES)
    got = {r.doc_id for r in rows}
    if name == "near_duplicates":
        assert {None, 9001, 9002, 9003, 9004, 9005} <= got and sum(r.doc_id == 9005 for r in rows) == 1
    if name in ("repeats", "benchmark"):
        assert {None, 9001, 9002, 9003, 9005} <= got and sum(r.doc_id == 9005 for r in rows) == 2
    if name == "mix":
        numbers = {}
        for r in rows:
            numbers.setdefault(key(r), []).append(r.copy_)
        assert all(sorted(n) in ([0], [0, 1], [0, 0], [0, 0, 1], [0, 0, 1, 1]) for n in numbers.values())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    out = stage(spark, docs, sf_dir)
    assert set(docs.columns) <= set(out.columns) and out.count() == 0


def test_results_may_be_read_in_any_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    built = [stage(spark, docs, sf_dir) for _, stage in corpus_pipeline.STAGES]
    counts = [df.count() for df in built[::-1]]
    assert counts == [df.count() for df in built[::-1]] and all(counts)


def test_a_run_leaves_its_result_only(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, sf_dir)
    left = set(os.listdir(shared)) - before
    assert out.count() and [p.rsplit("-", 1)[0] for p in left] == ["pipeline-mix"]


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.range(200).selectExpr(
        "id AS doc_id", "concat('w ', id) AS text", "'s' AS source", "concat('own', id) AS text_hash",
        "id * 2 AS rows", "id * 3 AS copies", "id * 5 AS _n", "id * 7 AS copy",
    )
    out = mixing.mixed_documents(docs).collect()
    assert {r.doc_id for r in out} == set(range(200))
    assert all((r.text_hash, r.rows, r.copies, r._n, r.copy) == (f"own{r.doc_id}", r.doc_id * 2, r.doc_id * 3, r.doc_id * 5, r.doc_id * 7) for r in out)


def test_the_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append((len(rows), sum(r.nbytes for r in rows), list(y))) or {"constant": 0.5})
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text number ', id, ' goes here') AS text")
    docs = docs.unionByName(spark.range(3000).selectExpr("7L AS doc_id", "concat('again ', id % 3) AS text"))
    labels = spark.range(300).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    quality.train(docs, labels, max_rows=10)
    quality.train(docs, labels)
    quality.train(docs, labels, max_bytes=5_000)
    quality.train(docs, labels, max_bytes=1)
    rows, size, _ = zip(*seen)
    held = spark.range(300).where(quality.held_out(F.col("id"))).count()
    assert rows[0] == 10 and rows[1] == 300 - held and 10 < rows[2] < rows[1] and size[2] <= 5_000 and rows[3] == 0
    # The same documents in every layout, the first by hash.
    quality.train(docs.repartition(9), labels, max_bytes=5_000)
    assert seen[-1] == seen[2]


def test_learning_does_not_depend_on_repeated_rows(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat(IF(id % 2 = 0, 'fine words ', 'bad junk '), id) AS text")
    labels = spark.range(200).selectExpr("id AS doc_id", "int(1 - id % 2) AS quality")
    once = quality.train(docs, labels)
    many = quality.train(docs.unionByName(docs.where("doc_id < 20")), labels)
    assert np.array_equal(once["weights"], many["weights"]) and once["curve"] == many["curve"]


def test_the_filter_of_changed_rows_is_no_value_in_a_plan(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, f"row {i}") for i in range(200)], "k long, words string")
    sure, possible = split(rows, rows.where("k % 5 = 0").select("k"), "k")
    for part in (sure, possible):
        assert part.columns == ["k", "words"]
        assert "ubquery" not in part._jdf.queryExecution().executedPlan().toString()
    listed = {i for i in range(200) if i % 7 and i % 5 == 0}
    assert {r.k for r in possible.collect()} == listed
    left = [r.k for r in sure.collect()]
    assert len(left) == 200 - len(listed) and left.count(None) == sum(i % 7 == 0 for i in range(200))
