"""Lining up several systems with the ground truth.

A row can be compared only if every system and the ground truth have it, exactly once, and
all of them are usable. Rows of all inputs are put in one stream and grouped once by key, with
map-side combining: a key that a faulty input repeats millions of times becomes one row per
task. The group's row holds a count and the scores of every system, packed into whole
numbers, so aggregation buffers have a fixed width and nothing is sorted. No join of
labels, so repeated keys never multiply. Feedback texts stay out of it; they are joined to the
comparable keys afterwards, or only their hashes are (``align_with_texts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import labels as L
from gradeloom.functions.hashing import text_hash
from gradeloom.operators.labels import parse_label, quoted, with_reason
from gradeloom.session import Scratch, materialize
from gradeloom.settings import CRITERIA


# A valid score needs four bits; this many fit a BIGINT.
_PER_PACK = 15


def _feedback(criteria: Sequence[str]) -> str:
    return f"array({', '.join(L.feedback_sql('parsed', t) for t in criteria)})"


def _packs(criteria: Sequence[str]) -> list[range]:
    n = len(criteria)
    return [range(i, min(i + _PER_PACK, n)) for i in range(0, n, _PER_PACK)]


def score_predictions(
    preds: DataFrame, key: Sequence[str], criteria: Sequence[str], with_feedback: bool = False
) -> DataFrame:
    """``*key, system, ok, p0..``: scores packed; the repair is applied to every label. With
    feedback also the texts of valid labels, as ``feedback``."""
    df = with_reason(preds, criteria, fix="extract", always=True)
    packs = [
        " + ".join(f"shiftleft(bigint(scores[{i}]), {4 * k})" for k, i in enumerate(own)) + f" AS p{m}"
        for m, own in enumerate(_packs(criteria))
    ]
    told = [f"IF(reason IS NULL, {_feedback(criteria)}, NULL) AS feedback"] if with_feedback else []
    return df.selectExpr(*quoted(key), "system", "reason IS NULL AS ok", *packs, *told)


def score_truth(
    truth: DataFrame, key: Sequence[str], criteria: Sequence[str], with_feedback: bool
) -> DataFrame:
    """``*key, system, ok, g0..`` of the ground truth, with a NULL system. It must parse as it
    stands and have a score for every trait; a score outside 1..10 is used as it is. With
    feedback it must also have a text for every trait; ``gt_feedback`` holds them."""
    names = [f"g{i}" for i in range(len(criteria))]
    cols = [f"try_cast({L.score_sql('parsed', t)} AS INT) AS {n}" for n, t in zip(names, criteria)]
    ok = " AND ".join(f"{n} IS NOT NULL" for n in names)
    if with_feedback:
        cols.append(f"{_feedback(criteria)} AS gt_feedback")
        ok += " AND forall(gt_feedback, x -> x IS NOT NULL)"
        names.append("gt_feedback")
    df = parse_label(truth).selectExpr(*quoted(key), *cols)
    return df.selectExpr(*quoted(key), "string(NULL) AS system", f"{ok} AS ok", *names)


def align(
    preds: DataFrame,
    truth: DataFrame,
    systems: Sequence[str],
    key: Sequence[str] = ("id",),
    criteria: Sequence[str] = CRITERIA,
    with_feedback: bool = False,
    nullable: Sequence[str] = ("trait",),
) -> DataFrame:
    """One row per key and input, with flags.

    ``preds``: key columns, ``system``, ``label``. ``truth``: key columns, ``label``. A key
    may be several columns (ids restart for each augmented trait, so augmented data needs
    ``("trait", "id")``). A key column that is NULL makes a row unusable: it is never
    complete. Only in the columns named by ``nullable`` is NULL a value like any other.

    Columns: key, ``system`` (NULL for the ground truth's own row), ``ok``, ``s0..`` and
    ``g0..`` (ground truth), ``complete`` (the key is in every input) and ``comparable``
    (complete, once in each, all usable). With ``with_feedback`` also the two feedback
    arrays, ``feedback`` and ``gt_feedback``, for comparable rows. Then parsed labels are written
    once, and both the scores and the texts are read from there.
    """
    key = list(key)
    preds = preds.where(F.col("system").isin(*systems))
    scored = score_predictions(preds, key, criteria, with_feedback)
    told = score_truth(truth, key, criteria, with_feedback)
    if with_feedback:
        scored, told = materialize(scored, "scored"), materialize(told, "scored-truth")
    aligned = _line_up(scored.drop("feedback"), told.drop("gt_feedback"), systems, key, criteria, nullable)
    if with_feedback:
        return _join_feedback(aligned, scored, told, key, "feedback", "gt_feedback")
    return aligned


def align_with_texts(
    preds: DataFrame,
    truth: DataFrame,
    systems: Sequence[str],
    tables: Scratch,
    key: Sequence[str] = ("id",),
    criteria: Sequence[str] = CRITERIA,
    nullable: Sequence[str] = ("trait",),
) -> tuple[DataFrame, DataFrame]:
    """``align`` with the hashes of the feedback, ``feedback_hash`` and ``gt_feedback_hash``, in
    place of the texts, and the texts of all usable inputs apart: ``text_hash, text``, a row for
    every time a text occurs.

    The texts stay where they were written with the parsed labels and do not move with the
    alignment. Both results read ``tables``.
    """
    key = list(key)
    preds = preds.where(F.col("system").isin(*systems))

    def hashed(df: DataFrame, texts: str) -> DataFrame:
        return df.withColumn(f"{texts}_hash", F.transform(texts, text_hash))

    scored = tables.save(hashed(score_predictions(preds, key, criteria, True), "feedback"), "scored")
    told = tables.save(hashed(score_truth(truth, key, criteria, True), "gt_feedback"), "scored-truth")
    scores = scored.drop("feedback", "feedback_hash"), told.drop("gt_feedback", "gt_feedback_hash")
    aligned = _line_up(*scores, systems, key, criteria, nullable)
    aligned = _join_feedback(aligned, scored, told, key, "feedback_hash", "gt_feedback_hash")

    def texts(df: DataFrame, name: str) -> DataFrame:
        each = df.where("ok").selectExpr(name, f"posexplode({name}_hash) AS (i, text_hash)")
        return each.selectExpr("text_hash", f"{name}[i] AS text")

    return aligned, texts(scored, "feedback").unionByName(texts(told, "gt_feedback"))


def _line_up(
    scored: DataFrame,
    told: DataFrame,
    systems: Sequence[str],
    key: list[str],
    criteria: Sequence[str],
    nullable: Sequence[str],
) -> DataFrame:
    """``align`` of scored inputs, without feedback."""
    n, packs = len(criteria), _packs(criteria)
    rows = scored.unionByName(told, allowMissingColumns=True)
    truths = [f"g{i}" for i in range(n)]
    aggregates, parts = [], []
    for j, name in enumerate(systems):
        own = f"system = {L.literal(name)}"
        aggregates += [f"count_if({own}) AS n{j}", f"count_if({own} AND ok) AS ok{j}"]
        aggregates += [f"max(IF({own}, p{m}, NULL)) AS p{j}_{m}" for m in range(len(packs))]
        scores = [
            f"int(shiftright(p{j}_{i // _PER_PACK}, {4 * (i % _PER_PACK)}) & 15) AS s{i}" for i in range(n)
        ]
        parts.append(
            f"struct({L.literal(name)} AS system, n{j} > 0 AS present, n{j} = ok{j} AS ok, {', '.join(scores)})"
        )
    aggregates += ["count_if(system IS NULL) AS nt", "count_if(system IS NULL AND ok) AS okt"]
    aggregates += [f"max({g}) AS {g}" for g in truths]
    own = ", ".join(f"{g} AS s{i}" for i, g in enumerate(truths))
    parts.append(f"struct(string(NULL) AS system, nt > 0 AS present, nt = okt AS ok, {own})")
    single = rows.groupBy(*key).agg(*[F.expr(x) for x in aggregates])

    counts = [(f"n{j}", f"ok{j}") for j in range(len(systems))] + [("nt", "okt")]
    usable = [f"{k} IS NOT NULL" for k, raw in zip(quoted(key), key) if raw not in nullable]
    complete = " AND ".join([*usable, *[f"{c} > 0" for c, _ in counts]])
    once = " AND ".join(f"{c} = 1 AND {ok} = 1" for c, ok in counts)
    flagged = single.selectExpr(
        *quoted(key), *truths, f"filter(array({', '.join(parts)}), x -> x.present) AS _rows",
        f"{complete} AS complete", f"{complete} AND {once} AS comparable",
    )
    names = [f"s{i}" for i in range(n)]
    return flagged.selectExpr(*quoted(key), *truths, "complete", "comparable", "inline(_rows)").selectExpr(
        *quoted(key), "system", "ok", *names, *truths, "complete", "comparable"
    )


def _join_feedback(
    aligned: DataFrame, scored: DataFrame, told: DataFrame, key: list[str], feedback: str, gt_feedback: str
) -> DataFrame:
    """Bring the texts, or their hashes, to the comparable rows. Their keys are unique in every
    input."""
    own = scored.where("ok").select(*key, "system", feedback).alias("p")
    told = told.select(*key, gt_feedback).alias("t")

    def same(side: str) -> str:
        return " AND ".join(f"a.{k} <=> {side}.{k}" for k in quoted(key)) + " AND a.comparable"

    joined = aligned.alias("a").join(own, F.expr(f"{same('p')} AND a.system = p.system"), "left")
    joined = joined.join(told, F.expr(same("t")), "left")
    return joined.select("a.*", f"p.{feedback}", f"t.{gt_feedback}")


def align_by_id(aligned: DataFrame) -> DataFrame:
    """The system rows whose key is in every input."""
    return aligned.where(F.col("complete") & F.col("system").isNotNull())


def valid_in_all_systems(aligned: DataFrame) -> DataFrame:
    """The system rows that take part in a comparison."""
    return aligned.where(F.col("comparable") & F.col("system").isNotNull())


def invalid_in_any_system(aligned: DataFrame) -> DataFrame:
    """The system rows that are in every input but cannot be compared."""
    return aligned.where(
        F.col("complete") & ~F.col("comparable") & F.col("system").isNotNull()
    )


def compare_coverage(aligned: DataFrame) -> DataFrame:
    """``compared``, ``total``: keys compared and keys present in every input."""
    return aligned.where(F.col("system").isNull()).agg(
        F.count_if("comparable").alias("compared"), F.count_if("complete").alias("total")
    )


def compared_traits(aligned: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Comparable rows as one row per key, system and trait, with the two texts or hashes of
    texts if ``aligned`` has them."""
    texts = ""
    if "feedback" in aligned.columns:
        texts = ", feedback[{0}] AS pred_text, gt_feedback[{0}] AS gt_text"
    elif "feedback_hash" in aligned.columns:
        texts = ", feedback_hash[{0}] AS pred_hash, gt_feedback_hash[{0}] AS gt_hash"
    rows = ", ".join(
        f"struct({L.literal(t)} AS trait, s{i} AS score, g{i} AS gt_score{texts.format(i)})"
        for i, t in enumerate(criteria)
    )
    drop = {f"{p}{i}" for p in "sg" for i in range(len(criteria))}
    drop |= {"feedback", "gt_feedback", "feedback_hash", "gt_feedback_hash"}
    keep = [c for c in aligned.columns if c not in drop]
    return valid_in_all_systems(aligned).selectExpr(*quoted(keep), f"inline(array({rows}))")
