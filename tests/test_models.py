"""Prompts, model calls, augmentation, fine-tuning rows, streaming and whole jobs."""

import json
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom import stubs
from gradeloom.functions import prompts as P
from gradeloom.operators import augment, infer, sft
from gradeloom.plans import prediction, preparation
from gradeloom.settings import CRITERIA
from gradeloom.sources import jsonl
from gradeloom.streaming.clean import append_clean_incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

SYSTEM_TEXT = """You are an expert speech evaluator. Given a transcript of a speaker's message, assess the communication quality in terms of the following traits:
    ['a', 'b c']

    For each trait, assign a score from 1 (poor) to 10 (excellent). Be honest and critical in your assessment without bias toward high scores.\x20
    Then provide a short explanation (1–2 sentences) justifying your score for that trait.

    The final output must be a JSON string with the exact format below:
    {'a': {'score': '<int>', 'feedback': '<string>'}, 'b c': {'score': '<int>', 'feedback': '<string>'}}"""

REWRITE_TEXT = """You are given a reference article-style sample.

                Imitate a writer who uses redundant connectors, rewrite the sample in a way that **includes filler words rarely but surely**.

                Only output the transcript content.

                ### Reference Sample:
                some text"""


def docs(spark, n=10):
    return spark.createDataFrame([(i, f"text {i} " + "w " * i) for i in range(n)], "id bigint, text string")


def test_prompt_texts(spark):
    df = spark.createDataFrame([(" hi ",)], "text string")
    m = df.select(P.prompt_messages(F.col("text"), ["a", "b c"]).alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", SYSTEM_TEXT), ("user", "Transcript:\n hi ")]
    j = df.select(P.judge_messages(F.col("text"), ["a", "b c"]).alias("m")).first().m
    assert j[0].content.strip() == SYSTEM_TEXT.replace("\n\n    The final", "\n    \n    The final")
    assert j[0].content.startswith("\n    You") and j[0].content.endswith("}\n    ")
    assert j[1].content == "\n    Transcript:\n     hi \n    "


def test_rewrite_prompt(spark):
    rows = [("filler words", "  some text\n"), ("transition logic", "x"), ("formality", ""), ("unknown", "x")]
    df = spark.createDataFrame(rows, "trait string, text string")
    out = {r.trait: r.p for r in df.select("trait", P.rewrite_prompt(F.col("trait"), F.col("text")).alias("p")).collect()}
    assert out["filler words"] == REWRITE_TEXT
    assert "sample.\n \n" in out["transition logic"]
    assert out["formality"].endswith("### Reference Sample:")
    assert out["unknown"] is None


def test_completion(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 1), ([1, 2], 2), ([1], 3)], "ids array<int>, n int")
    got = [r.c for r in df.select(P.completion(F.col("ids"), F.col("n")).alias("c")).collect()]
    assert got == [[2, 3, 4], [], []]


class FlakyClient:
    """Fails the first try of every call whose text holds 'flaky', always on 'dead'."""

    def __call__(self):
        seen = Counter()

        def call(system, user):
            seen[user] += 1
            if "dead" in user or ("flaky" in user and seen[user] == 1):
                raise RuntimeError("down")
            return "```json\n{}\n```"

        return call


def test_judge_retries_and_keeps_failures(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "flaky"), (3, "dead")], "id bigint, text string")
    out = {r.id: r for r in infer.judge_label_rows(df, FlakyClient(), pause=0.0, concurrency=2).collect()}
    assert (out[1].label, out[1].error, out[1].attempts) == ("{}", None, 1)
    assert (out[2].label, out[2].error, out[2].attempts) == ("{}", None, 2)
    assert (out[3].label, out[3].error, out[3].attempts) == (None, "RuntimeError: down", 2)


class BatchModel:
    """Answers with the batch size; raises if the batch holds the word 'bad'."""

    def __call__(self):
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [str(len(prompts))] * len(prompts)

        return model


def test_failing_batch_fails_whole(spark):
    texts = ["x"] * 9
    texts[4] = "bad"
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    out = {r.id: r for r in infer.batch_infer(df, BatchModel(), batch_size=4).collect()}
    assert [out[i].label for i in range(9)] == ["4"] * 4 + [None] * 4 + ["1"]
    assert {out[i].error for i in range(4, 8)} == {"ValueError: no"}


def test_inference_sends_only_the_prompt_to_python(spark):
    df = docs(spark).withColumn("payload", F.lit("p"))
    plan = infer.batch_infer(df, stubs.LengthModel())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "payload" not in plan


def test_many_systems(spark):
    systems = {s: stubs.LengthModel(s) for s in ("e1", "e2")}
    out = infer.infer_many_systems(docs(spark), systems)
    assert {(r.system, r.label.split(":")[0]) for r in out.collect()} == {("e1", "e1"), ("e2", "e2")}
    assert out.count() == 20


def test_augment(spark):
    out = augment.augment_minority(docs(spark, 30), 5, stubs.rewrite_client).collect()
    assert Counter(r.trait for r in out) == {t: 5 for t in P.PERSONAS}
    assert all(sorted(r.id for r in out if r.trait == t) == [1, 2, 3, 4, 5] for t in P.PERSONAS)
    assert all(r.text.startswith("rewritten") and r.original == r.original.strip() for r in out)


def test_until_first_error(spark):
    rows = [("p", 1, None), ("p", 2, "e"), ("p", 3, None), ("q", 1, None)]
    df = spark.createDataFrame(rows, "trait string, id bigint, error string")
    assert {tuple(r) for r in augment.until_first_error(df).collect()} == {("p", 1), ("q", 1)}


def brute_mask(prompt, output, size):
    p, f = [len(w) for w in prompt.split()], [len(w) for w in (prompt + output).split()]
    ids = (f[:size] + [0] * size)[:size]
    cut = min(len(p), size)
    return ids, [-100] * cut + ids[cut:], [1] * min(len(f), size) + [0] * (size - min(len(f), size))


@pytest.mark.parametrize("size", [5, 90, 120, 400])
def test_token_masks(spark, size):
    df = docs(spark, 6).withColumn("label", F.concat(F.lit(" answer of "), F.col("id"), F.lit(" words here")))
    examples = sft.sft_examples(df)
    texts = {
        r.id: (r.p, r.output)
        for r in examples.select("id", P.chat_text(F.col("messages")).alias("p"), "output").collect()
    }
    out = sft.sft_tokenize_mask(examples, stubs.word_length_tokenizer, size)
    for r in out.collect():
        ids, labels, mask = brute_mask(*texts[r.id], size)
        assert (r.input_ids, r.labels, r.attention_mask) == (ids, labels, mask)
    budget = sft.sft_token_budget(out, size).first()
    full = [len((p + o).split()) for p, o in texts.values()]
    assert budget.n_truncated == sum(n > size for n in full)
    assert budget.n_fully_masked == sum(len(p.split()) >= size for p, _ in texts.values())
    assert budget.tokens_kept == sum(min(n, size) for n in full)


def test_conversations_are_kept_whole(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
        (1, 3, "user", "u2"), (1, 4, "assistant", "a2"),
        (2, 0, "user", "v1"), (2, 1, "user", "v2"), (2, 2, "assistant", "b2"), (2, 2, "assistant", "b3"),
        (2, 3, "user", "v3"), (3, 5, "assistant", "c"), (None, 1, "user", "n"), (4, None, "user", None),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = sft.conversation_sft(df).collect()
    assert len(rows) == len(turns)
    assert sorted(((r.conv_id, r.turn, r.role, r.content) for r in rows), key=repr) == sorted(turns, key=repr)
    assert {r.content for r in rows if r.target} == {"a1", "a2", "b2", "b3"}
    assert {r.content for r in rows if r.unanswered} == {"v1", "v3"}
    assert {r.content for r in rows if r.duplicate} == {"b2", "b3"}


def test_answers_must_match_prompts(spark):
    def few():
        return lambda texts: ["only one"]

    def many():
        return lambda texts: [t for t in texts for _ in range(2)]

    df = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "id bigint, text string").coalesce(1)
    for model in (few, many):
        rows = infer.batch_infer(df, model, batch_size=2).collect()
        assert [r.label for r in rows] == [None] * 4 and all("answers for 2 prompts" in r.error for r in rows)

    def silent():
        return lambda system, user: None

    rows = infer.judge_label_rows(df, silent, pause=0.0).collect()
    assert {(r.label, r.error, r.attempts) for r in rows} == {(None, "ValueError: no answer", 2)}
    examples = sft.sft_examples(df.withColumn("label", F.lit("x")))
    with pytest.raises(Exception, match="tokenizer gave"):
        sft.sft_tokenize_mask(examples, lambda: lambda texts: [[1]]).collect()


def record(i, ok=True):
    label = {c: {"score": 1 + (i + k) % 10, "feedback": "f"} for k, c in enumerate(CRITERIA)}
    text = json.dumps(label)
    return {"id": i, "text": f"t{i}", "label": text if ok else text[:40], "trait": None}


def test_streaming_append(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def add(name, rows):
        (src / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        append_clean_incremental(spark, str(src), out, ck).awaitTermination()
        return sorted(r.id for r in jsonl.scan_folders(spark, [out], pattern="*.json").collect())

    add("a.jsonl", [record(1), record(2, ok=False)])
    assert run() == [1]
    assert run() == [1]  # nothing new, nothing added
    add("b.jsonl", [record(3), record(4)])
    assert run() == [1, 3, 4]
    assert run() == [1, 3, 4]


def test_clean_and_split_job(spark, tmp_path):
    src = tmp_path / "labeled"
    src.mkdir()
    (src / "x.jsonl").write_text("".join(json.dumps(record(i, ok=i % 10 != 3)) + "\n" for i in range(200)))
    out = preparation.clean_and_split(spark, [str(src)], str(tmp_path / "split"))
    counts = Counter(r.split for r in out.collect())
    assert counts == {"train": 144, "val": 18, "test": 18}
    assert sorted(r.id for r in out.collect()) == [i for i in range(200) if i % 10 != 3]


class GoodJudge:
    def __call__(self):
        label = json.dumps({c: {"score": 5, "feedback": "f"} for c in CRITERIA})
        return lambda system, user: f"```json\n{label}\n```"


def test_label_corpus_job(spark):
    out = preparation.label_corpus(docs(spark, 8), GoodJudge(), stubs.rewrite_client, 3, pause=0.0)
    rows = out.collect()
    assert Counter(r.trait for r in rows) == {None: 8, **{t: 3 for t in P.PERSONAS}}
    assert all(r.error is None and r.label.startswith("{") for r in rows)


def test_predict_file_job(spark, tmp_path):
    path = tmp_path / "test.jsonl"
    path.write_text("\n".join(["", json.dumps({"id": 1, "text": "a"}), json.dumps({"id": 2, "text": "b"})]) + "\n")
    out = prediction.predict_file(spark, str(path), str(tmp_path / "pred"), {"e1": stubs.LengthModel("m")})
    assert {(r.system, r.id, r.text) for r in out.collect()} == {("e1", 1, "a"), ("e1", 2, "b")}


def test_write_read_round_trip(spark, tmp_path):
    odd = 'quote " back\\slash \n newline é ü \t tab'
    df = spark.createDataFrame([(1, odd, None)], "id bigint, text string, label string")
    jsonl.write_jsonl(df, str(tmp_path / "o"))
    jsonl.write_jsonl(df, str(tmp_path / "o"))  # replaces
    rows = jsonl.scan_folders(spark, [str(tmp_path / "o")], pattern="*.json").collect()
    assert [(r.id, r.text, r.label) for r in rows] == [(1, odd, None)]


def test_examples_without_an_output_are_counted(spark):
    df = docs(spark, 6).withColumn("label", F.when(F.col("id") % 3 > 0, F.lit("a b")))
    tokens = sft.sft_tokenize_mask(sft.sft_examples(df), stubs.word_length_tokenizer, 2000)
    rows = {r.id: r for r in tokens.collect()}
    assert len(rows) == 6 and [rows[i].error for i in (0, 1, 3)] == [sft.NO_OUTPUT, None, sft.NO_OUTPUT]
    empty = rows[0]
    assert empty.n_full is empty.input_ids is empty.labels is empty.attention_mask is None
    budget = sft.sft_token_budget(tokens, 2000).first()
    assert (budget.n, budget.n_without_output) == (4, 2)
    assert budget.tokens_total == sum(rows[i].n_full for i in (1, 2, 4, 5))


def test_python_gets_small_batches(spark):
    """Python holds a batch several times over: prompts as text, tokens and answers."""
    from gradeloom.operators import engine, sft

    def count():
        def sizes(texts):
            if sum(map(len, texts)) > 9_000_000:
                raise ValueError("a batch of more than 9 MB")
            return [len(t) for t in texts]

        return sizes

    def tokenizer():
        check = count()
        return lambda texts: [[n] for n in check(texts)]

    df = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('word ', 20000) AS text", "'label' AS label")
    assert engine.engine_infer(df, stubs.LengthModel(), count_factory=count).where("error IS NULL").count() == 400
    tokens = sft.sft_tokenize_mask(sft.sft_examples(df), tokenizer)
    assert tokens.where("size(input_ids) > 0").count() == 400
