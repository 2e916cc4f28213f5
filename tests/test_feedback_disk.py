"""The embedding match of feedback: what it leaves on disk, what it moves, and that no text is lost or
encoded twice whatever the filters pass by chance."""

import json
import os
import sys
import uuid
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom import catalog, session, stubs
from gradeloom.functions.hashing import text_hash
from gradeloom.operators import align as A
from gradeloom.operators import match
from gradeloom.session import Scratch
from gradeloom.settings import CRITERIA

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


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


def noted(folder):
    return Counter(t for f in os.listdir(folder) for t in json.loads((Path(folder) / f).read_text()))


@pytest.fixture
def own_folder(monkeypatch, tmp_path):
    """Tables are written to a folder of the test's own."""
    folder = tmp_path / "shared"
    folder.mkdir()
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(folder))
    return folder


def label(*words):
    return json.dumps({t: {"score": 5, "feedback": f"{w} {i}"} for i, (t, w) in enumerate(zip(CRITERIA, words * 6))})


def labels(spark):
    """Systems that agree on some texts, repeated and null keys, and a row that cannot be compared."""
    truth = [(i, label(f"truth{i}")) for i in range(20)] + [(None, label("truth0")), (7, label("again"))]
    preds = [(s, i, label("shared") if i < 5 else label(f"own{i % 9}{s}")) for s in ("a", "b") for i in range(20)]
    preds += [("a", None, label("null")), ("a", 9, label("twice")), ("b", 11, "broken")]
    return (
        spark.createDataFrame(preds, "system string, id int, label string").repartition(3),
        spark.createDataFrame(truth, "id int, label string").repartition(2),
    )


def test_the_query_leaves_only_what_its_result_reads(spark, own_folder, sf_dir):
    out = catalog.QUERIES["feedback_match_embedding"](spark, sf_dir)
    left = {p.name.rsplit("-", 1)[0] for p in own_folder.iterdir()} - {"label_gt", "label_pred"}
    assert left == {"pairs-to-match", "pair-scores"}
    assert out.count() == 18


def test_no_text_moves_with_the_alignment(spark, own_folder):
    with Scratch(spark) as tables:
        aligned, _ = A.align_with_texts(*labels(spark), ("a", "b"), tables)
        traits = A.compared_traits(aligned)
        plan = traits._jdf.queryExecution().executedPlan().toString()
    assert "pred_hash" in traits.columns and "pred_text" not in traits.columns
    assert "parse_json" not in plan.lower() and "feedback:array<string>" not in plan


def test_a_saved_table_leaves_no_shuffle_and_goes(spark, own_folder):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = (Path(f).name for f in blocks.getAllFiles().mkString("\n").split("\n"))
        return {f for f in names if f.startswith("shuffle_")}

    before, found = spark.conf.get(key, None), shuffles()
    with Scratch(spark) as tables:
        df = tables.save(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
        assert sorted(r["count"] for r in df.collect()) == [142, 143, 143, 143, 143, 143, 143]
        assert len(list(own_folder.iterdir())) == 1
        assert not shuffles() - found
    assert not list(own_folder.iterdir()) and spark.conf.get(key, None) in (before, "false")


def test_match_by_hash_is_match_by_text(spark, tmp_path):
    preds, truth = labels(spark)
    plain = A.compared_traits(A.align(preds, truth, ("a", "b"), with_feedback=True))
    plain = match.embedding_match(plain, stubs.letter_encoder).select("system", "id", "trait", "precision", "recall", "f1")
    (tmp_path / "seen").mkdir()
    with Scratch(spark) as tables:
        aligned, texts = A.align_with_texts(preds, truth, ("a", "b"), tables)
        traits = A.compared_traits(aligned).drop("ok")
        got = match.embedding_match(traits, Noting(tmp_path / "seen"), 4, texts, tables.clear)
    assert got.columns == [*traits.columns, "precision", "recall", "f1"]
    got = got.select("system", "id", "trait", "precision", "recall", "f1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.count() == 2 * 6 * 17  # but for keys 7 and 9, which repeat, and 11, which is broken
    assert set(noted(tmp_path / "seen").values()) == {1}


@pytest.mark.parametrize("digits", [7, 9, 28])
def test_filters_that_pass_too_much_lose_and_double_nothing(spark, own_folder, monkeypatch, digits):
    monkeypatch.setattr(match, "MAX_FILTER_DIGITS", digits)
    monkeypatch.setattr(match, "ROW_DIGITS", 1)
    if digits == 28:
        monkeypatch.undo()
    texts = [f"text {i}" for i in range(300) for _ in range(1 + i % 3)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    df = df.select(text_hash(F.col("text")).alias("text_hash"), "text")
    needed = df.where("text IS NULL OR text = '' OR substr(text, -1) IN ('1', '2')").select("text_hash")
    with Scratch(spark) as tables:
        parts = [[r.text for r in own.collect()] for own in match.each_once(df, needed, tables)]
    got = Counter(t for own in parts for t in own)
    assert set(got.values()) == {1}
    wanted = {"", *(t for t in texts if t and t[-1] in "12")}
    assert wanted <= set(got)
    if digits == 28:
        assert set(got) == wanted and set(parts[-1]) == {t for t in wanted if texts.count(t) == 1 and t}


def test_vectors_survive_packing():
    rng = np.random.default_rng(3)
    for v in (rng.normal(size=(17, 5)), np.array([[np.nan, -0.0, np.inf]]), np.ones((2000, 3))):
        assert match._unpacked(match._packed(v), *v.shape).tobytes() == v.tobytes()
    assert match._unpacked(b"", 0, 3).size == match._unpacked(b"", 4, 0).size == 0


def test_best_cosines_both_ways_in_chunks():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(37, 4)), rng.normal(size=(23, 4))
    cosines = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert match._best(a, b, chunk=8) == pytest.approx((cosines.max(1).mean(), cosines.max(0).mean()))
    assert match._best(a, np.empty((0, 4))) == (0.0, 0.0)
