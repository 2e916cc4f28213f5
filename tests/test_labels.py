"""Rules for labels: expected values are written out."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import jsontext as J
from gradeloom.operators import labels as O
from gradeloom.operators import split as S
from gradeloom.settings import CRITERIA


def one(spark, values, name="x"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, {name} string")


def apply(spark, fn, values):
    rows = one(spark, values).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


A, B = "formality", "filler words"


def label(a='{"score": 7, "feedback": "fine"}', b='{"score": 3, "feedback": "many"}'):
    parts = [f'"{k}": {v}' for k, v in ((A, a), (B, b)) if v is not None]
    return "{" + ", ".join(parts) + "}"


def scored(text):
    return label(a='{"score": %s, "feedback": "fine"}' % text)


# (label, strict, lenient reason, formality score when lenient-valid)
RULES = [
    (label(), True, None, 7),
    (scored("1"), True, None, 1),
    (scored("10"), True, None, 10),
    (scored("0"), False, "Score in 'formality' outside range", None),
    (scored("11"), False, "Score in 'formality' outside range", None),
    (scored("-3"), False, "Score in 'formality' outside range", None),
    (scored("99999999999"), False, "Score in 'formality' outside range", None),
    (scored("99999999999999999999999"), False, "Score in 'formality' outside range", None),
    (scored("1e300"), False, "Score in 'formality' outside range", None),
    (scored("1e999"), False, "Score in 'formality' is not int", None),
    (scored("7.0"), False, None, 7),
    (scored("7.9"), False, None, 7),
    (scored("7e0"), False, None, 7),
    (scored("0.9"), False, "Score in 'formality' outside range", None),
    (scored('"7"'), False, None, 7),
    (scored('" 7 "'), False, None, 7),
    (scored('"+7"'), False, None, 7),
    (scored('"1_0"'), False, None, 10),
    (scored('"_7"'), False, "Score in 'formality' is not int", None),
    (scored('"12"'), False, "Score in 'formality' outside range", None),
    (scored('"99999999999999999999999"'), False, "Score in 'formality' outside range", None),
    (scored('"7.5"'), False, "Score in 'formality' is not int", None),
    (scored('"seven"'), False, "Score in 'formality' is not int", None),
    (scored('""'), False, "Score in 'formality' is not int", None),
    (scored("null"), False, "Score in 'formality' is not int", None),
    (scored("[7]"), False, "Score in 'formality' is not int", None),
    (scored("{}"), False, "Score in 'formality' is not int", None),
    (scored("true"), True, None, 1),
    (scored("false"), False, "Score in 'formality' outside range", None),
    (label(a=None), False, "Missing field: formality", None),
    (label(b=None), False, "Missing field: filler words", None),
    (label(a="null"), False, "Field 'formality' is not a dict", None),
    (label(a="7"), False, "Field 'formality' is not a dict", None),
    (label(a="[1]"), False, "Field 'formality' is not a dict", None),
    (label(a='"x"'), False, "Field 'formality' is not a dict", None),
    (label(a="{}"), False, "Field 'formality' missing 'score' or 'feedback'", None),
    (label(a='{"score": 7}'), False, "Field 'formality' missing 'score' or 'feedback'", None),
    (label(a='{"feedback": "x"}'), False, "Field 'formality' missing 'score' or 'feedback'", None),
    (label(a='{"score": 7, "feedback": 5}'), False, "Feedback in 'formality' is not str", None),
    (label(a='{"score": 7, "feedback": null}'), False, "Feedback in 'formality' is not str", None),
    (label(a='{"score": 7, "feedback": ["x"]}'), False, "Feedback in 'formality' is not str", None),
    # the score is looked at before the feedback, and traits in order
    (label(a='{"score": 70, "feedback": 5}'), False, "Score in 'formality' outside range", None),
    (label(a='{"score": 0, "feedback": "x"}', b="1"), False, "Score in 'formality' outside range", None),
    # more keys than needed
    (label()[:-1] + ', "overall": 3}', True, None, 7),
    (label(a='{"score": 7, "feedback": "x", "note": null}'), True, None, 7),
    # the last of two equal keys counts
    (label(a='{"score": 99, "score": 7, "feedback": "x"}'), True, None, 7),
    ("[1, 2]", False, "Missing field: formality", None),
    ('"text"', False, "Missing field: formality", None),
    ("{}", False, "Missing field: formality", None),
    ("3", False, "Label is not an object", None),
    ("2.5", False, "Label is not an object", None),
    ("true", False, "Label is not an object", None),
    ("null", False, "Label is not an object", None),
    ("", False, "Unrecoverable JSON decode error", None),
    ("   ", False, "Unrecoverable JSON decode error", None),
    ("no json", False, "Unrecoverable JSON decode error", None),
    (None, False, "Unrecoverable JSON decode error", None),
    # unreadable as it stands; the lenient side repairs
    (label() + " thanks", False, None, 7),
    (label() + "] x", False, None, 7),
    (label() + "] }", False, "Unrecoverable JSON decode error", None),
    (label() + "}", False, "Unrecoverable JSON decode error", None),
    (label() + "," + label(), False, "Unrecoverable JSON decode error", None),
    (label()[:-1], False, None, 7),
    (label()[:-1] + " , }", False, None, 7),
    ("```json\n" + label() + "\n```", False, None, 7),
    ("Sure: ```json" + label() + "``` and {more}", False, None, 7),
    (label().replace('"', "'"), False, "Unrecoverable JSON decode error", None),
]


@pytest.fixture(scope="module")
def ruled(spark):
    df = one(spark, [r[0] for r in RULES], "label")
    strict = {r.i for r in O.filter_valid_strict(df, [A, B]).collect()}
    lenient = {r.i: r for r in O.validate_lenient(df, [A, B]).collect()}
    return strict, lenient


@pytest.mark.parametrize("i", range(len(RULES)))
def test_rules(ruled, i):
    strict, lenient = ruled
    text, is_strict, reason, value = RULES[i]
    assert (i in strict) == is_strict, text
    assert lenient[i].reason == reason, text
    assert (lenient[i].scores[0] if lenient[i].scores else None) == value, text


def test_strict_implies_lenient(ruled):
    strict, lenient = ruled
    assert all(lenient[i].reason is None for i in strict)


@pytest.mark.parametrize(
    "before, after",
    [
        ('{"a": 1,}', '{"a": 1}'),
        ('{"a": [1, 2, ]}', '{"a": [1, 2]}'),
        ('{"a": 1 ,\n\t}', '{"a": 1 }'),
        ('{"a": 1, }', '{"a": 1}'),
        ('{"a": "x, }"}', '{"a": "x}"}'),  # also inside strings
        ('{"a": {"b": 1}', '{"a": {"b": 1}}'),
        ('{"a": {"b": {"c": 1', '{"a": {"b": {"c": 1}'),  # one brace at most
        ('{"a": "{"}', '{"a": "{"}}'),  # braces in strings count
        ("", ""),
        ("plain", "plain"),
        (",}", "}"),
        (",,}", ",}"),
    ],
)
def test_simple_fix(spark, before, after):
    assert apply(spark, J.simple_fix, [before]) == [after]


@pytest.mark.parametrize(
    "before, after",
    [
        ('x ```json\n{"a": 1}\n``` y {"b": 2}', '{"a": 1}'),
        ('```json{"a": {"b": 1}}```', '{"a": {"b": 1}}'),
        ('```json {"a": 1} ``` ```json {"b": 2} ```', '{"a": 1}'),
        ('```json\n{"a":\n1}', '{"a":\n1}'),  # unclosed fence: braces decide
        ('```\n{"a": 1}\n```', '{"a": 1}'),
        ('say {"a": 1} and {"b": 2} ok', '{"a": 1} and {"b": 2}'),
        ('} {"a": 1', '} {"a": 1'),  # the last } is before the first {
        ("  none \n", "none"),
        ('  {"a": 1  ', '{"a": 1}'),
        ('é {"a": "ü"} ß', '{"a": "ü"}'),
        ("{}", "{}"),
        ("{", "{}"),
        ("}{", "}{"),
    ],
)
def test_extract_and_fix(spark, before, after):
    assert apply(spark, J.extract_and_fix, [before]) == [after]


def test_fix_is_idempotent(spark, sf_dir):
    from gradeloom.sources import views

    once = J.extract_and_fix(F.col("label"))
    df = views.label_pred(spark, sf_dir).where("label like '%}'").select(once.alias("a"))
    assert df.where(F.col("a") != J.extract_and_fix(F.col("a"))).count() == 0


@pytest.mark.parametrize(
    "before, after",
    [
        ("```json\n{}\n```", "{}"),
        (" \n```json\n{}\n```\t ", "{}"),
        ("```json {}\n```", "```json {}"),
        ("```json\n{}", "{}"),
        ("{}\n```", "{}"),
        ("{}", "{}"),
        ("```json\n```json\n{}", "```json\n{}"),
    ],
)
def test_strip_code_fence(spark, before, after):
    assert apply(spark, J.strip_code_fence, [before]) == [after]


def test_clean_labels_replaces_repaired_text(spark):
    good = json.dumps({c: {"score": 5, "feedback": "x"} for c in CRITERIA})
    rows = [
        (1, "t1", good),
        (2, "t2", good[:-1]),
        (3, "t3", good[:-1] + ",}"),
        (4, "t4", "Sure: " + good),  # cleaning does not extract
        (None, "t5", good),
        (6, "t6", None),
    ]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    out = {r.id: r.label for r in O.clean_labels(df).collect()}
    assert out == {1: good, 2: good, 3: good}


def test_parse_runs_once_per_row(spark, sf_dir):
    """The parse is not copied into the filter, and everything is native."""
    from gradeloom.sources import views

    plan = O.clean_labels(views.label_pred(spark, sf_dir))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    below = text.split("Generate", 1)[1]
    assert "Filter" in text.split("Generate", 1)[0]
    assert "parsed#" not in below.split("\n", 1)[1]
    assert "Python" not in text and "Exchange" not in text


STRATA = [
    (label(), "high_low"),
    (scored("6"), "low_low"),
    (scored("6.5"), "high_low"),
    (scored("true"), "low_low"),
    (scored('"7"'), "unknown"),
    (scored("null"), "unknown"),
    (label(a=None), "low"),
    (label(a="{}"), "unknown"),
    (label(a="null"), "unknown"),
    ("{}", ""),
    ("[]", ""),
    ("3", "unknown"),
    ("null", "unknown"),
    ("oops", "unknown"),
    (None, "unknown"),
]


def test_strat_key(spark):
    df = one(spark, [s[0] for s in STRATA], "label")
    out = S.with_strat_key(df, [A, B], 6).orderBy("i").collect()
    assert [r.strat_key for r in out] == [s[1] for s in STRATA]


def test_traits_to_long(spark):
    df = one(spark, [label(), label(a=None)], "label")
    rows = O.traits_to_long(df, [A, B]).select("i", "trait", "score", "feedback").collect()
    assert sorted(map(tuple, rows)) == [(0, B, 3, "many"), (0, A, 7, "fine")]


def test_trait_names_with_quotes(spark):
    name = "speaker's tone"
    df = one(spark, [json.dumps({name: {"score": 4, "feedback": "ok"}}), "{}"], "label")
    out = {r.i: r for r in O.validate_lenient(df, [name]).collect()}
    assert out[0].scores == [4]
    assert out[1].reason == "Missing field: speaker's tone"


def test_union_and_projection(spark):
    a = spark.createDataFrame([(1, "x", "l", 9)], "id bigint, text string, label string, extra int")
    b = spark.createDataFrame(
        [(1, "x", "l", "empathy")], "id bigint, text string, label string, trait string"
    )
    out = O.union_sources(O.project_labeled(a), O.project_labeled(b)).collect()
    assert sorted((r.id, r.trait or "") for r in out) == [(1, ""), (1, "empathy")]
    assert O.union_sources(a, a).count() == 2
