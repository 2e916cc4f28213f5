"""Systems replaced one at a time, streams with rejects, stored line numbers, texts encoded once."""

import json
import os
import sys
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom import stubs
from gradeloom.operators import align as A
from gradeloom.operators import match
from gradeloom.plans import prediction
from gradeloom.settings import CRITERIA
from gradeloom.sources import jsonl, store
from gradeloom.streaming import clean

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*") if p.is_file()}


def answers(spark, name, n=5):
    return spark.range(n).selectExpr("id", "string(id) AS text", f"'{name}' AS label", "string(NULL) AS error")


def rows(spark, path):
    return Counter((r.system, r.label) for r in store.read_systems(spark, path).collect())


# --- systems ------------------------------------------------------------------------------


def test_a_rerun_leaves_the_other_systems_alone(spark, tmp_path):
    path = str(tmp_path)
    assert store.read_systems(spark, path).count() == 0
    store.replace_systems(spark, {"a": answers(spark, "a"), "b": answers(spark, "b")}, path)
    before, old = files(tmp_path), store.read_systems(spark, path)
    store.replace_systems(spark, {"b": answers(spark, "b2", 7)}, path)
    assert rows(spark, path) == {("a", "a"): 5, ("b", "b2"): 7}
    assert {p: files(tmp_path)[p] for p in before} == before
    assert Counter(r.label for r in old.collect()) == {"a": 5, "b": 5}  # it still reads what it read
    gone = store.vacuum(spark, path)
    assert len(gone) == 1 and rows(spark, path) == {("a", "a"): 5, ("b", "b2"): 7}
    assert store.vacuum(spark, path) == []
    store.remove_system(spark, path, "a")
    assert rows(spark, path) == {("b", "b2"): 7}
    with pytest.raises(KeyError):
        store.remove_system(spark, path, "a")


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path = str(tmp_path)
    store.replace_systems(spark, {"a": answers(spark, "a")}, path)
    broken = answers(spark, "x").withColumn("label", F.raise_error(F.lit("broken model")).cast("string"))
    with pytest.raises(Exception, match="broken model"):
        store.replace_systems(spark, {"a": answers(spark, "new"), "b": broken}, path)
    assert rows(spark, path) == {("a", "a"): 5}
    assert len(store.vacuum(spark, path)) >= 1 and rows(spark, path) == {("a", "a"): 5}


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    plain = jsonl.write_jsonl

    def slow(df, where, rest="rest"):
        monkeypatch.setattr(jsonl, "write_jsonl", plain)
        store.replace_systems(spark, {"b": answers(spark, "quick")}, path)
        plain(df, where, rest)

    monkeypatch.setattr(jsonl, "write_jsonl", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        store.replace_systems(spark, {"a": answers(spark, "slow")}, path)
    assert rows(spark, path) == {("b", "quick"): 5}


def test_predicting_one_checkpoint_again(spark, tmp_path):
    (tmp_path / "test.jsonl").write_text("\n".join(json.dumps({"id": i, "text": f"t{i}"}) for i in range(4)))
    args = spark, str(tmp_path / "test.jsonl"), str(tmp_path / "out")
    prediction.predict_file(*args, {"e1": stubs.LengthModel("e1"), "e2": stubs.LengthModel("e2")})
    before = files(tmp_path / "out" / "data")
    out = prediction.predict_file(*args, {"e2": stubs.LengthModel("again")})
    assert Counter((r.system, r.label.split(":")[0]) for r in out.collect()) == {("e1", "e1"): 4, ("e2", "again"): 4}
    after = files(tmp_path / "out" / "data")
    assert {p: after[p] for p in before} == before


# --- streams ------------------------------------------------------------------------------

GOOD = {t: {"score": 4, "feedback": "fine"} for t in CRITERIA}


def records(start, n):
    kinds = [
        json.dumps(GOOD), json.dumps(GOOD)[:-1], "no json", json.dumps({**GOOD, "formality": {"score": "4", "feedback": "x"}}),
        json.dumps({k: v for k, v in GOOD.items() if k != "empathy"}),
    ]
    return [{"id": i, "text": f"t{i}", "label": kinds[i % 5], "extra": {"n": i}} for i in range(start, start + n)]


def test_every_row_counts_once_also_after_a_failure(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    args = [str(tmp_path / f) for f in ("in", "valid", "rejected", "checkpoint")]

    def add(name, rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        clean.clean_with_rejects(spark, *args).awaitTermination()

    add("a.jsonl", records(0, 50))
    run()
    add("b.jsonl", [*records(50, 50), {"id": None, "text": "x", "label": json.dumps(GOOD)}])
    plain = clean.write_jsonl

    def broken(df, path, rest="rest"):
        if "rejected" in path:
            raise RuntimeError("disk full")
        plain(df, path, rest)

    monkeypatch.setattr(clean, "write_jsonl", broken)
    with pytest.raises(Exception, match="disk full"):
        run()
    monkeypatch.setattr(clean, "write_jsonl", plain)
    run()
    run()  # nothing new
    valid = clean.scan_batches(spark, args[1]).select("*", F.to_json("rest").alias("r")).collect()
    bad = clean.scan_batches(spark, args[2]).select("*", F.to_json("rest").alias("r")).collect()
    assert sorted(r.id for r in valid) == [i for i in range(100) if i % 5 < 2]
    assert all(json.loads(r.label) == GOOD for r in valid)
    assert {json.loads(r.r)["extra"]["n"] for r in valid} == {r.id for r in valid}
    assert Counter(r.id for r in bad) == {**{i: 1 for i in range(100) if i % 5 >= 2}, None: 1}
    why = {r.id: json.loads(r.r)["rejected"] for r in bad}
    assert why[None] == clean.NO_KEY and why[3] == clean.NOT_STRICT
    assert why[4] == "Missing field: empathy" and "decode" in why[2]
    assert {json.loads(r.r).get("extra", {}).get("n") for r in bad} == {r.id for r in bad}


# --- line numbers -------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def lines_in(folder):
    folder.mkdir()
    want = []
    for k in (10, 2, 1):
        own = [f"{k}-{i} " + "x" * (i * 7 % 60) for i in range(100)]
        (folder / f"part-{k}.txt").write_text("\n".join(own) + "\n")
        want = own + want
    return want


def test_line_numbers_from_a_stored_index(spark, tmp_path, small_splits):
    want = lines_in(tmp_path / "in")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    path, index = str(tmp_path / "in"), str(tmp_path / "index")

    def scan():
        return [r.value for r in jsonl.scan_lines_by_index(spark, path, index).orderBy("pos").collect()]

    assert scan() == want
    counted = spark.read.parquet(index)
    assert counted.count() > 10 and counted.agg(F.sum("lines")).first()[0] == 300
    stored, left = files(index), set(os.listdir(shared))
    assert scan() == want  # nothing is written for it
    assert files(index) == stored and set(os.listdir(shared)) == left
    got = jsonl.scan_lines_by_index(spark, path, index).select("pos").collect()
    assert sorted(r.pos for r in got) == list(range(300))


def test_a_changed_file_is_refused(spark, tmp_path, small_splits):
    lines_in(tmp_path / "in")
    path, index = str(tmp_path / "in"), str(tmp_path / "index")
    jsonl.build_line_index(spark, path, index)
    with open(tmp_path / "in" / "part-2.txt", "a") as f:
        f.write("one more\n")
    with pytest.raises(Exception, match="not in the index"):
        jsonl.scan_lines_by_index(spark, path, index).collect()
    jsonl.build_line_index(spark, path, index)
    assert jsonl.scan_lines_by_index(spark, path, index).count() == 301
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    with pytest.raises(Exception, match="cut otherwise"):
        jsonl.scan_lines_by_index(spark, path, index).collect()


def test_no_single_task_orders_the_splits(spark, tmp_path, small_splits):
    lines_in(tmp_path / "in")
    df = jsonl.scan_lines_by_index(spark, str(tmp_path / "in"), str(tmp_path / "index"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


# --- feedback -----------------------------------------------------------------------------


class Noting:
    """An encoder that notes every text it is given."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self):
        encode = stubs.letter_encoder()

        def run(texts):
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(json.dumps(list(texts)))
            return encode(texts)

        return run


def test_every_text_is_encoded_once(spark, tmp_path):
    texts = ["a b", "b c d", "", "a b", "e"]
    pairs = [(s, i, texts[(i + s) % 5], texts[i % 5]) for s in range(3) for i in range(40)] + [(0, 99, None, "a b")]
    df = spark.createDataFrame(pairs, "system int, i int, pred_text string, gt_text string").repartition(6)
    got = match.embedding_match(df, Noting(tmp_path), batch=2).collect()
    seen = Counter(t for f in os.listdir(tmp_path) for t in json.loads((tmp_path / f).read_text()))
    assert seen == dict.fromkeys(set(texts), 1)
    assert len(got) == len(pairs)
    by = {(r.pred_text, r.gt_text): (r.precision, r.recall, r.f1) for r in got}
    assert by["a b", "a b"] == pytest.approx((1.0, 1.0, 1.0)) and by["", "b c d"] == (0.0, 0.0, 0.0)
    assert by[None, "a b"] == (0.0, 0.0, 0.0)


def test_labels_are_parsed_once_for_feedback(spark, sf_dir):
    from gradeloom.sources import views

    df = A.align(views.label_pred(spark, sf_dir), views.label_gt(spark, sf_dir), views.SYSTEMS, with_feedback=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan.lower() and "label#" not in plan
