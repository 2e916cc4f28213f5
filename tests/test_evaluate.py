"""Alignment, metrics, reports and files."""

import json
from collections import Counter

import pytest

from gradeloom.settings import CRITERIA
from pyspark.sql import functions as F

from gradeloom import stubs
from gradeloom.operators import align as A
from gradeloom.operators import labels as O
from gradeloom.operators import match
from gradeloom.operators import metrics as M
from gradeloom.plans.evaluation import evaluate_files, validate_records
from gradeloom.sources import jsonl, report

T = ["p", "q"]


def lab(p, q, fp="good work", fq="fine"):
    return json.dumps({"p": {"score": p, "feedback": fp}, "q": {"score": q, "feedback": fq}})


@pytest.fixture(scope="module")
def small(spark):
    preds = [
        ("s1", 1, lab(5, 5)), ("s2", 1, lab(7, 1)),
        ("s1", 2, lab(5, 5)), ("s2", 2, "broken"),
        ("s1", 3, lab(2, 2)),
        ("s1", 4, lab(3, 3)), ("s1", 4, lab(9, 9)), ("s2", 4, lab(3, 3)),
        ("s1", 5, lab(1, 10)), ("s2", 5, "Sure! " + lab(10, 1)),
        ("s1", 6, lab(5, 5)), ("s2", 6, lab(5, 5)),
        ("s1", 7, lab(4, 4)), ("s2", 7, lab(4, 4)),
        ("zz", 1, lab(1, 1)),
    ]
    truth = [
        (1, lab(6, 3)), (2, lab(5, 5)), (3, lab(2, 2)), (4, lab(3, 3)), (5, lab(12, 5)),
        (6, json.dumps({"p": {"score": 5, "feedback": "x"}})), (7, lab(4, 4) + ",}"), (8, lab(1, 1)),
    ]
    p = spark.createDataFrame(preds, "system string, id bigint, label string")
    g = spark.createDataFrame(truth, "id bigint, label string")
    return A.align(p, g, ["s1", "s2"], criteria=T, with_feedback=True)


def test_alignment_cases(small):
    assert {(r.id, r.system) for r in A.valid_in_all_systems(small).collect()} == {
        (i, s) for i in (1, 5) for s in ("s1", "s2")
    }
    # complete: in both systems and the truth. 2: broken label, 4: repeated in s1, 6: truth
    # lacks a trait, 7: truth is not repaired.
    assert {r.id for r in A.align_by_id(small).collect()} == {1, 2, 4, 5, 6, 7}
    assert {r.id for r in A.invalid_in_any_system(small).collect()} == {2, 4, 6, 7}
    assert A.compare_coverage(small).first().asDict() == {"compared": 2, "total": 6}


def test_mse_by_hand(small):
    per = M.trait_mse(A.compared_traits(small, T))
    got = {(r.system, r.trait): r.mse for r in per.collect()}
    assert got == {
        ("s1", "p"): (1 + 121) / 2,  # a ground-truth score of 12 is used as it is
        ("s1", "q"): (4 + 25) / 2,
        ("s2", "p"): (1 + 4) / 2,
        ("s2", "q"): (4 + 16) / 2,
    }
    overall = {r.system: r.overall_mse for r in M.overall_mse(per).collect()}
    assert overall == {"s1": (61 + 14.5) / 2, "s2": (2.5 + 10) / 2}


def test_overall_mse_of_stored_example(spark):
    values = [6.1525, 1.6525, 3.3898, 4.8898, 34.9746, 1.8220]
    df = spark.createDataFrame([("base", v) for v in values], "system string, mse double")
    assert M.overall_mse(df).first().overall_mse == pytest.approx(8.8136, abs=1e-3)


def test_composite_key_with_nulls(spark):
    preds = [("s1", None, 1, lab(5, 5)), ("s1", "p", 1, lab(1, 1))]
    truth = [(None, 1, lab(5, 5)), ("p", 1, lab(2, 2))]
    p = spark.createDataFrame(preds, "system string, trait string, id bigint, label string")
    g = spark.createDataFrame(truth, "trait string, id bigint, label string")
    out = A.align(p, g, ["s1"], ["trait", "id"], T)
    got = {r.trait_: r.mse for r in M.trait_mse(
        A.compared_traits(out.withColumnRenamed("trait", "trait_"), T).withColumn("system", F.coalesce("trait_", F.lit("-")))
    ).withColumnRenamed("system", "trait_").collect()}
    assert got == {"-": 0.0, "p": 1.0}


def test_no_system_against_itself_differs(spark, sf_dir):
    from gradeloom.sources import views

    gt = views.label_gt(spark, sf_dir)
    out = A.align(gt.withColumn("system", F.lit("me")), gt, ["me"], with_feedback=True)
    rows = A.compared_traits(out)
    assert {r.mse for r in M.trait_mse(rows).collect()} == {0.0}
    empty = rows.where(F.trim("pred_text") == "").count()
    f1 = [r.f1 for r in M.feedback_match(M.lexical_match(rows.where(F.trim("pred_text") != ""))).collect()]
    assert f1 == [1.0] * 6 and empty < rows.count()


def test_hot_key_is_combined_before_the_shuffle(spark):
    many = spark.range(0, 30000).select(
        F.lit("s1").alias("system"), F.lit(1).cast("bigint").alias("id"), F.lit(lab(5, 5)).alias("label")
    )
    g = spark.createDataFrame([(1, lab(5, 5))], "id bigint, label string")
    out = A.align(many, g, ["s1"], criteria=T)
    assert A.compare_coverage(out).first().asDict() == {"compared": 0, "total": 1}
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "SortAggregate" not in plan
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_null_keys_are_never_paired(spark):
    p = spark.createDataFrame([("s1", None, lab(5, 5)), ("s1", 1, lab(5, 5))], "system string, id bigint, label string")
    g = spark.createDataFrame([(None, lab(5, 5)), (1, lab(5, 5))], "id bigint, label string")
    out = A.align(p, g, ["s1"], criteria=T)
    assert A.compare_coverage(out).first().asDict() == {"compared": 1, "total": 1}


def test_feedback_is_joined_to_comparable_rows_only(small):
    rows = {(r.id, r.system): r for r in small.collect()}
    assert rows[1, "s1"].feedback is not None and rows[1, "s1"].gt_feedback is not None
    assert rows[2, "s1"].feedback is None


def test_lexical_match_of_long_texts_is_not_quadratic(spark):
    import time

    def seconds(n):
        words = " ".join(f"w{i % (n // 3)}" for i in range(n))
        df = spark.createDataFrame([(words, words + " more")], "pred_text string, gt_text string")
        start = time.perf_counter()
        r = M.lexical_match(df).first()
        assert r.precision == 1.0 and r.recall == pytest.approx(n / (n + 1))
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 4 * seconds(20_000) + 1


def test_line_numbers_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"{i}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        df = jsonl.scan_lines_with_position(spark, str(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150k")
        assert df.where("pos = bigint(value)").count() == 60_000 == df.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parts_are_numbered_by_number(spark, tmp_path):
    for n in (20000, 99999, 100000, 100001):
        (tmp_path / f"part-{n}-x9.txt").write_text(f"{n}\n")
    got = jsonl.scan_lines_with_position(spark, str(tmp_path)).orderBy("pos").collect()
    assert [int(r.value) for r in got] == [20000, 99999, 100000, 100001]


def test_an_object_is_no_label_and_an_id_may_be_text(spark, tmp_path):
    good = {t: {"score": 5, "feedback": "x"} for t in CRITERIA}
    rows = [{"id": 1, "label": json.dumps(good)}, {"id": 2, "label": good}, {"id": "a7", "label": json.dumps(good)}]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    df = jsonl.scan_folders(spark, [str(tmp_path)])
    assert [r.id for r in O.clean_labels(df).collect()] == [1]
    df = jsonl.scan_folders(spark, [str(tmp_path)], "id STRING, label STRING")
    assert sorted(r.id for r in O.clean_labels(df).collect()) == ["1", "a7"]


def brute(p, g):
    pt, gt = p.lower().split(), g.lower().split()
    pr = sum(x in gt for x in pt) / len(pt) if pt else 0.0
    re_ = sum(x in pt for x in gt) / len(gt) if gt else 0.0
    return pr, re_, 2 * pr * re_ / (pr + re_) if pr + re_ else 0.0


PAIRS = [("a b c", "a b d"), ("a a b", "a"), ("", "x"), ("", ""), ("Good Work", "good work"), ("x", "y"), ("a b a b", "b c c")]


def test_lexical_match(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, pred_text string, gt_text string")
    for r in M.lexical_match(df).collect():
        assert (r.precision, r.recall, r.f1) == pytest.approx(brute(*PAIRS[r.i]))


def test_embedding_match(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, pred_text string, gt_text string")
    rows = {r.i: r for r in match.embedding_match(df, stubs.letter_encoder, batch=2).collect()}
    assert rows[1].precision < 1 and rows[1].recall == pytest.approx(1.0)
    assert rows[2].f1 == 0.0 and rows[3].f1 == 0.0
    encode = stubs.letter_encoder()

    def unit(text):
        return [v / (v @ v) ** 0.5 for v in encode([text])[0]]

    for i, (p, g) in enumerate(PAIRS):
        a, b = unit(p), unit(g)
        pr = sum(max(x @ y for y in b) for x in a) / len(a) if a and b else 0.0
        re_ = sum(max(x @ y for x in a) for y in b) / len(b) if a and b else 0.0
        f1 = 2 * pr * re_ / (pr + re_) if pr + re_ > 0 else 0.0
        got = (rows[i].precision, rows[i].recall, rows[i].f1)
        assert got == pytest.approx((pr, re_, f1))
    same = spark.createDataFrame([("one two", "two one")], "pred_text string, gt_text string")
    assert match.embedding_match(same, stubs.letter_encoder).first().f1 == pytest.approx(1.0)


def test_summary_from_histogram(spark, sf_dir):
    from gradeloom.sources import views

    v = O.validate_lenient(views.label_pred(spark, sf_dir)).persist()
    rows = [(r.system, r.scores) for r in v.where("reason is null").select("system", "scores").collect()]
    from gradeloom.settings import CRITERIA

    for r in M.trait_summary_sweep(v, [3, 6]).collect():
        i = CRITERIA.index(r.trait)
        s = [x[i] for name, x in rows if name == r.system]
        assert (r.min_score, r.max_score) == (min(s), max(s))
        assert r.avg_score == pytest.approx(sum(s) / len(s))
        assert (r.n_above, r.n_at_or_below) == (
            sum(x > r.threshold for x in s), sum(x <= r.threshold for x in s))


def test_first_k_errors_limits_before_the_shuffle(spark, sf_dir):
    from gradeloom.sources import views

    df = M.first_k_errors(O.validate_lenient(views.label_pred(spark, sf_dir)), 10, "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.index("WindowGroupLimit") < plan.index("Exchange")


def test_positions_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    one = tmp_path / "one.txt"
    one.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = jsonl.scan_lines_with_position(spark, str(one))
        assert spark.read.text(str(one)).rdd.getNumPartitions() > 5
        assert [r.value for r in df.orderBy("pos").collect()] == lines
        assert df.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (0, 4999, 5000)
        folder = str(tmp_path / "parts")
        rows = spark.createDataFrame(list(enumerate(lines)), "i int, value string").repartition(9)
        jsonl.write_lines_in_order(rows, "i", folder)
        got = jsonl.scan_lines_with_position(spark, folder).orderBy("pos").collect()
        assert [r.value for r in got] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


LINES = [
    (json.dumps({"id": 1, "text": "t", "label": lab(5, 5)}), None),
    ("", "Outer JSON error"),
    ("  ", "Outer JSON error"),
    ('{"id": 2', "Outer JSON error"),
    ('{"id": 2} x', "Outer JSON error"),
    ('{"id": 2, "text": "t"}', "Outer JSON error"),
    ("[1]", "Outer JSON error"),
    ("7", "Outer JSON error"),
    (json.dumps({"id": 3, "label": {"p": 1}}), "Label is not an object"),
    (json.dumps({"id": 4, "label": None}), "Label is not an object"),
    (json.dumps({"id": 5, "label": "nope"}), "Unrecoverable JSON decode error"),
    (json.dumps({"label": lab(5, 50)}), "Score in 'q' outside range"),
]


def test_outer_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "pos int, value string")
    out = validate_records(jsonl.records_of_lines(df), T).orderBy("pos").collect()
    assert [r.reason for r in out] == [e for _, e in LINES]
    assert out[0].id == 1 and out[0].scores == [5, 5] and out[11].id is None


def write_file(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else r + "\n" for r in rows))
    return str(path)


def test_evaluate_files_by_id_and_position(spark, tmp_path):
    truth = [{"id": i, "text": "t", "label": lab(5, 5)} for i in range(1, 7)]
    good = [{"id": i, "text": "t", "label": lab(6, 3)} for i in range(1, 7)]
    lost = [{"id": i, "text": "t", "label": lab(i, i)} for i in (1, 3, 4, 5, 6)]  # 2 is lost
    files = {"good": write_file(tmp_path / "a.jsonl", good), "lost": write_file(tmp_path / "b.jsonl", lost)}
    gt = write_file(tmp_path / "gt.jsonl", truth)
    ev = evaluate_files(spark, files, gt, T)
    assert ev.coverage.first().asDict() == {"compared": 5, "total": 5}
    assert {(r.system, r.trait): r.mse for r in ev.traits.collect()} == {
        ("good", "p"): 1.0, ("good", "q"): 4.0,
        ("lost", "p"): (16 + 4 + 1 + 0 + 1) / 5, ("lost", "q"): (16 + 4 + 1 + 0 + 1) / 5,
    }
    by_pos = evaluate_files(spark, files, gt, T, by="pos")
    assert by_pos.coverage.first().asDict() == {"compared": 5, "total": 5}
    out = str(tmp_path / "report")
    report.write_report(ev.lines, out)
    text = [r.value for r in spark.read.text(out).collect()]
    head = ["", "{} check with score threshold 6:", "Valid samples: 6/6", "Invalid samples: 0", ""]
    assert text[:5] == [x.format("good") for x in head]
    at = text.index("ground truth check with score threshold 6:")
    assert text[at - 1 : at + 4] == [x.format("ground truth") for x in head]
    assert "  Avg Score: 6.00" in text and "  >6: 0 | <=6: 6" in text
    assert "Generated File: lost" in text and "  overall_avg_mse: 4.4000" in text
    assert text[-1].startswith("Compared 5/5 lines successfully")


def test_evaluate_files_with_feedback(spark, tmp_path):
    truth = [{"id": i, "text": "t", "label": lab(5, 5, "good work", "fine")} for i in (1, 2)]
    pred = [{"id": i, "text": "t", "label": lab(5, 4, "good", "fine")} for i in (2, 1)]
    files = {"s": write_file(tmp_path / "s.jsonl", pred)}
    ev = evaluate_files(
        spark, files, write_file(tmp_path / "g.jsonl", truth), T, thresholds=(3, 6), with_feedback=True
    )
    got = {r.trait: (r.precision, r.recall) for r in ev.match.collect()}
    assert got == {"p": (1.0, 0.5), "q": (1.0, 1.0)}
    assert ev.overall_match.first().overall_f1 == pytest.approx((2 / 3 + 1) / 2)
    report.write_report(ev.lines, str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert text.index("s check with score threshold 3:") < text.index("s check with score threshold 6:")
    assert text[-18:-1] == [
        "", "", "", "MSE and Match Metrics across generated files:", "",
        "Generated File: s",
        "  p: 0.0000", "  p_match_precision: 1.0000", "  p_match_recall: 0.5000", "  p_match_f1: 0.6667",
        "  q: 1.0000", "  q_match_precision: 1.0000", "  q_match_recall: 1.0000", "  q_match_f1: 1.0000",
        "  overall_avg_mse: 0.5000", "  overall_avg_match_f1: 0.8333", "",
    ]
    assert text[-1].startswith("Compared 2/2")


def test_fixed_rounds_like_python(spark):
    values = [0.125, 2.675, 1.005, 4.766666, 8.81355, 0.0, 10.0, 34.97455]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", report.fixed(F.col("v"), 2).alias("t"))
    assert all(r.t == f"{r.v:.2f}" for r in df.collect())


def test_nothing_valid(spark):
    p = spark.createDataFrame([("s", 1, "x")], "system string, id bigint, label string")
    g = spark.createDataFrame([(1, lab(1, 1))], "id bigint, label string")
    out = A.align(p, g, ["s"], criteria=T)
    assert A.compare_coverage(out).first().asDict() == {"compared": 0, "total": 1}
    assert M.overall_mse(M.trait_mse(A.compared_traits(out, T))).count() == 0


def test_observed_counts(spark):
    df, obs = M.observe_rows(spark.range(100), "step", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 100, "even": 50}


def test_folder_scan_keeps_only_matching_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    write_file(tmp_path / "a" / "x.jsonl", [{"id": 1, "text": "t", "label": "l"}])
    write_file(tmp_path / "b" / "y.jsonl", [{"id": 2, "text": "t", "label": "l", "trait": "p"}])
    write_file(tmp_path / "b" / "z.txt", [{"id": 3}])
    df = jsonl.scan_folders(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {(r.id, r.trait, r.source_file.rsplit("/", 1)[1]) for r in df.collect()} == {
        (1, None, "x.jsonl"), (2, "p", "y.jsonl")
    }


def test_skip_blank(spark, tmp_path):
    path = write_file(tmp_path / "x.jsonl", [{"id": 1, "text": "a"}, "", "  ", {"id": 2, "text": "b"}])
    df = jsonl.scan_skip_blank(spark, path, jsonl.RAW_SCHEMA)
    assert Counter(r.id for r in df.collect()) == {1: 1, 2: 1}
    bad = write_file(tmp_path / "y.jsonl", ["{broken"])
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        jsonl.scan_skip_blank(spark, bad, jsonl.RAW_SCHEMA).collect()


def test_word_match_needs_no_search_per_word(spark):
    rows = [("a b a C", "c a x"), ("a", None), (None, "a"), ("", "a"), ("a\x1cb\x85c", "B a"), ("İ x", "i̇ X")]
    df = spark.createDataFrame(rows, "pred_text string, gt_text string")
    got = M.lexical_match(df)
    assert [(r.precision, r.recall) for r in got.collect()] == [
        (0.75, pytest.approx(2 / 3)), (None, 0.0), (0.0, None), (0.0, 0.0), (pytest.approx(2 / 3), 1.0), (1.0, 1.0),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "sort_array" not in plan


def test_writers_compress(spark, tmp_path):
    from gradeloom.streaming import clean as stream

    good = json.dumps({t: {"score": 5, "feedback": "x" * 500} for t in CRITERIA})
    rows = spark.createDataFrame([(i, good if i % 2 else "none", "a" if i < 5 else "b") for i in range(9)], "id long, label string, split string")
    jsonl.write_partitioned(rows, f"{tmp_path}/parts", "split", compression="gzip")
    got = jsonl.scan_split(spark, f"{tmp_path}/parts", "split")
    assert {(r.id, r.label, r.split) for r in got.collect()} == {tuple(r) for r in rows.collect()}
    jsonl.write_jsonl(rows.drop("split"), f"{tmp_path}/in", compression="gzip")
    sinks = [f"{tmp_path}/{x}" for x in ("in", "valid", "rejected", "checkpoint")]
    stream.clean_with_rejects(spark, *sinks, pattern="*.json.gz", compression="gzip").awaitTermination()
    found = [{r.id for r in stream.scan_batches(spark, s).collect()} for s in sinks[1:3]]
    assert found == [{1, 3, 5, 7}, {0, 2, 4, 6, 8}]
    assert not list(tmp_path.rglob("part-*.json")) and not list(tmp_path.rglob("part-*.txt"))
