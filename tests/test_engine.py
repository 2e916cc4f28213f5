"""Judge calls kept in a ledger, and inference in batches under a token budget."""

import os
import sys
import threading
import time
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom.operators import engine, infer, ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Counting:
    """A client that notes every call in a folder."""

    def __init__(self, folder, broken=(), deadly=None):
        self.folder, self.broken, self.deadly = str(folder), broken, deadly

    def __call__(self):
        def call(system, user):
            if self.deadly and self.deadly in user:
                time.sleep(3)  # others get done meanwhile
                os._exit(1)
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(user.strip().removeprefix("Transcript:").strip())
            if any(b in user for b in self.broken):
                raise ValueError("refused")
            return "```json\n" + str(len(user)) + "\n```"

        return call

    def calls(self):
        return Counter(open(f"{self.folder}/{f}").read() for f in os.listdir(self.folder))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def judged(df, path, client, **more):
    out = ledger.judge_with_ledger(df, str(path), client, pause=0.0, **more)
    return {r.id: (r.label, r.error, r.attempts) for r in out.collect()}


def test_every_prompt_is_asked_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client, path = Counting(tmp_path / "calls", broken=["no 3"]), tmp_path / "ledger"
    texts = [f"no {i % 7}" for i in range(40)] + ["", "", ""]
    df = docs(spark, texts).withColumn("label", F.lit("old"))
    first = judged(df, path, client, calls_per_task=3)
    assert len(first) == 43 and first[3] == (None, "ValueError: refused", 2)
    assert first[0] == first[7] and first[0][1:] == (None, 1)
    calls = client.calls()
    assert {t: n for t, n in calls.items() if t.startswith("no")} == {f"no {i}": 2 if i == 3 else 1 for i in range(7)}
    # Again: only what failed is asked; a mended client answers it, and nothing is left to ask.
    assert judged(df, path, client) == first
    assert client.calls() == calls + Counter({"no 3": 2})
    mended = Counting(tmp_path / "calls")
    third = judged(df, path, mended)
    assert third[3][1] is None and {i: v for i, v in third.items() if texts[i] != "no 3"} == {
        i: v for i, v in first.items() if texts[i] != "no 3"
    }
    before = client.calls()
    assert judged(df.where("id < 20"), path, mended) == {i: v for i, v in third.items() if i < 20}
    assert client.calls() == before
    assert judged(df.limit(0), path, mended) == {}


def test_a_run_that_dies_midway_keeps_its_answers(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path, texts = tmp_path / "ledger", [f"text {i}." for i in range(60)]
    df = docs(spark, texts)
    dying = Counting(tmp_path / "calls", deadly="text 33.")
    with pytest.raises(Exception, match="(?s)crash|exited|failed"):
        judged(df, path, dying, calls_per_task=5)
    kept = ledger.read_ledger(spark, str(path)).count()
    called = dying.calls()
    assert 0 < kept < 60 and max(called.values()) == 1
    done = judged(df, path, Counting(tmp_path / "calls"), calls_per_task=5)
    assert len(done) == 60 and all(error is None for _, error, _ in done.values())
    again = dying.calls()
    assert sum(again.values()) == sum(called.values()) + 60 - kept
    assert ledger.read_ledger(spark, str(path)).count() == 60


def test_the_same_answers_as_without_a_ledger(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client = Counting(tmp_path / "calls", broken=["x2"])
    df = docs(spark, [f"x{i}" for i in range(9)])
    plain = {
        r.id: (r.label, r.error, r.attempts) for r in infer.judge_label_rows(df, client, pause=0.0).collect()
    }
    assert judged(df, tmp_path / "ledger", client) == plain


@pytest.mark.parametrize("budget, most", [(1, 5), (10, 3), (64, 128), (10_000, 4)])
def test_packs_under_the_budget(budget, most):
    costs = [(i * 37) % 23 + 1 for i in range(100)]
    batches = engine.pack(costs, budget, most)
    assert sorted(i for b in batches for i in b) == list(range(100))
    for own in batches:
        assert len(own) <= most
        assert len(own) == 1 or max(costs[i] for i in own) * len(own) <= budget
    assert engine.pack([], budget, most) == []


class Strict:
    """A model that refuses batches beyond the budget and answers with its prompt."""

    def __init__(self, budget, slow=0.0, broken=None):
        self.budget, self.slow, self.broken = budget, slow, broken

    def __call__(self):
        count = engine.characters()

        def model(texts):
            time.sleep(self.slow)
            costs = count(texts)
            if len(texts) > 1 and max(costs) * len(costs) > self.budget:
                raise ValueError("too wide")
            if self.broken and any(self.broken in t for t in texts):
                return texts[1:]
            return [t.upper() for t in texts]

        return model


@pytest.mark.parametrize("overlap", [0, 2])
def test_answers_come_back_in_order(spark, overlap):
    rows = [(i, "w" * ((i * 97) % 400) + f" {i}" if i % 50 else None, i * 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, prompt string, more long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = engine.generate_rows(df, "prompt", Strict(300), 300, 16, overlap=overlap).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0].asDict().keys() == {"id", "more", "answer", "error"}
    assert {r.id: (r.more, r.answer, r.error) for r in out} == {i: (m, (p or "").upper(), None) for i, p, m in rows}


def test_an_error_is_that_of_its_batch(spark):
    rows = [(i, f"prompt {i:03}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, prompt string").coalesce(1)
    out = engine.generate_rows(df, "prompt", Strict(10_000, broken="017"), max_batch=8).collect()
    bad = [r for r in out if r.error]
    assert len(out) == 40 and len(bad) == 8 and 17 in {r.id for r in bad}
    assert {r.error for r in bad} == {"ValueError: 7 answers for 8 prompts"}

    def short():
        return lambda texts: [1]

    with pytest.raises(Exception, match="1 counts for 40 prompts"):
        engine.generate_rows(df, "prompt", Strict(9), count_factory=short).collect()


def threads():
    return [t for t in threading.enumerate() if t.name == "prepare-batches"]


def test_prepares_while_the_reader_works():
    def slow():
        for i in range(6):
            time.sleep(0.2)
            yield i

    start = time.perf_counter()
    for _ in engine.ahead(slow(), 2):
        time.sleep(0.2)
    assert time.perf_counter() - start < 6 * 0.4 - 0.6
    assert not threads()


def test_waits_when_enough_is_prepared():
    taken = []

    def source():
        for i in range(50):
            taken.append(i)
            yield i

    reader = engine.ahead(source(), 2)
    assert next(reader) == 0
    time.sleep(0.5)
    assert len(taken) <= 5
    reader.close()
    assert not threads()


def test_errors_come_after_the_items_before_them():
    def source():
        yield 1
        yield 2
        raise RuntimeError("broken source")

    seen = []
    with pytest.raises(RuntimeError, match="broken source"):
        for x in engine.ahead(source(), 1):
            seen.append(x)
    assert seen == [1, 2] and not threads()
    assert list(engine.ahead(iter([]), 1)) == []


def test_overlap_in_a_job(spark):
    """Counting tokens and the model take as long as each other; together they take less."""

    def slow_count():
        def count(texts):
            time.sleep(0.3)
            return [1] * len(texts)

        return count

    df = spark.range(80).selectExpr("id", "string(id) AS prompt").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    took = {}
    try:
        for overlap in (0, 2):
            start = time.perf_counter()
            engine.generate_rows(df, "prompt", Strict(10**6, slow=0.3), count_factory=slow_count, overlap=overlap).collect()
            took[overlap] = time.perf_counter() - start
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert took[2] < took[0] - 1.0


def test_the_stage_gets_its_resources(spark, monkeypatch):
    given = []
    kind = type(spark.range(1))
    plain = kind.mapInArrow

    def spy(self, func, schema, barrier=False, profile=None):
        given.append(profile)
        return plain(self, func, schema, barrier)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    profile = object()
    out = engine.engine_infer(docs(spark, ["a"]), Strict(10**6), profile=profile)
    assert out.count() == 1 and given == [profile]
