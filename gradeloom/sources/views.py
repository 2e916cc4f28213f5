"""Label and prediction views derived from the given ``documents`` table.

The given tables hold no model output, so labels are derived from each document with
integer arithmetic and string functions: a clean ground truth, and three systems whose
output is damaged in the ways real model output is. Like the files of a real evaluation
they are stored once (per application and input folder) and then read by every query.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.session import scratch_path
from gradeloom.settings import CRITERIA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Score seeds, one per trait.
_SEEDS = (
    "n_chars",
    "doc_id * 7 + n_chars",
    "doc_id * 3 + 1",
    "doc_id + n_chars * 3",
    "n_chars * 13 + 2",
    "doc_id * doc_id",
)


# All but A-Z, a-z and the blank. Java finds these ranges many times faster than a negated class.
_NO_LETTER = r"[\x{0}-\x1F!-@\[-`{-\x{10FFFF}]"


def _pieces(shift: int) -> list[str]:
    """``f0 ..``: trait i gets the i-th of as many equal slices of the text as there are
    traits, so that the feedbacks together hold the whole text; ``shift`` moves the slices."""
    k, out = len(CRITERIA), []
    for i in range(k):
        start, stop = f"length(text) * {i} div {k}", f"length(text) * {i + 1} div {k}"
        piece = f"substring(text, int({start}) + {1 + shift}, int({stop}) - int({start}))"
        out.append(f"trim(regexp_replace({piece}, r'{_NO_LETTER}', ' ')) AS f{i}")
    return out


def _trait_json(trait: str, score: str, i: int) -> str:
    return f"""concat('"{trait}": {{"score": ', {score}, ', "feedback": "', f{i}, '"}}')"""


def _object(parts: list[str]) -> str:
    return f"concat('{{', concat_ws(', ', {', '.join(parts)}), '}}')"


_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _stored(build):
    """Write the view on first use and read it back after that."""

    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key in _STORED:
            path, schema = _STORED[key]
            try:
                return spark.read.schema(schema).parquet(path)
            except AnalysisException:  # the shared folder was emptied meanwhile
                pass
        df = build(spark, sf_dir)
        path = scratch_path(spark, build.__name__)
        df.write.option("compression", "zstd").parquet(path)
        _STORED[key] = path, df.schema
        return spark.read.schema(df.schema).parquet(path)

    return view


@_stored
def label_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label: always valid. Its text is that of the document."""
    parts = [
        _trait_json(t, f"string(({m}) % 10 + 1)", i)
        for i, (t, m) in enumerate(zip(CRITERIA, _SEEDS))
    ]
    sliced = documents(spark, sf_dir).selectExpr("doc_id", "n_chars", *_pieces(0))
    return sliced.selectExpr("doc_id AS id", f"{_object(parts)} AS label")


@_stored
def label_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, id, label: three systems, two of them with damaged rows."""
    parts = []
    for i, (t, m) in enumerate(zip(CRITERIA, _SEEDS)):
        n = f"string(({m} + (doc_id + {i}) % (4 - k)) % 10 + 1)"
        n = {
            "formality": f"IF(c = 10, 'null', {n})",
            "persuasiveness": f"IF(c = 4, '11', {n})",
            "enthusiasm": f"""IF(c = 5, concat('"', {n}, '"'), {n})""",
            "empathy": f"IF(c = 6, concat({n}, '.9'), {n})",
        }.get(t, n)
        part = _trait_json(t, n, i)
        parts.append(f"IF(c <> 3, {part}, NULL)" if t == "filler words" else part)
    label = r"""CASE c
        WHEN 0 THEN concat(left(j, length(j) - 1), ',}')
        WHEN 1 THEN left(j, length(j) - 1)
        WHEN 2 THEN concat('Here is my rating:\n```json\n', j, '\n```\nDone.')
        WHEN 7 THEN left(j, 120)
        WHEN 8 THEN 'I cannot rate this.'
        WHEN 9 THEN concat(j, ' Hope this helps')
        ELSE j END AS label"""
    return (
        documents(spark, sf_dir)
        # Sliced before the rows are tripled: the systems share the texts of their feedback.
        .selectExpr("doc_id", "n_chars", *_pieces(2))
        .selectExpr("*", "explode(sequence(0, 2)) AS k")
        .selectExpr("*", "IF(k < 2, (doc_id + k * 5) % 16, 15) AS c")
        .selectExpr("*", f"{_object(parts)} AS j")
        .selectExpr("concat('sys', string(k)) AS system", "doc_id AS id", label)
    )


SYSTEMS = ("sys0", "sys1", "sys2")


def with_text(labels: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` with the ``text`` of their documents; the views do not store it again."""
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return labels.join(texts, "id")
