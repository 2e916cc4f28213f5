"""License scans: ordered signature rules with a keyword prefilter, inside one scan.

A text becomes its words, each between two spaces. Texts without any anchor of the rules are
done. For the others, rules whose keyword stands in the text are matched; every match is an
interval of words. Matches are then walked through in the order of their start, the longest
first, with the furthest end so far per level: what lies within a match of the same or a
stronger level is suppressed. Everything is a column expression of one row, so there is no
shuffle and nothing is gathered.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import lower_ascii
from gradeloom.llm.license_rules import ANCHORS, Rule, rules, spaced
from gradeloom.operators.labels import evaluate_once

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = 4
CHUNK = 256
PLACES = "array<struct<start:bigint,stop:bigint>>"


def _words(x: str) -> str:
    """SQL: the number of words of a piece of the spaced text."""
    return f"((octet_length({x}) - octet_length(replace({x}, ' ', ''))) div 2)"


def places(text: str, pattern: str) -> str:
    """SQL: where a pattern matches, ``start`` and ``stop`` in words.

    The pieces between the matches give the distances. Their running sum is taken in chunks
    of 256 matches, then over the chunks, so a text of very many matches stays cheap.
    """
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    gaps = (
        f"zip_with(slice(split({text}, {pattern}, -1), 1, size({found})), {found},"
        f" (a, b) -> struct({_words('a')} AS gap, {_words('b')} AS len))"
    )
    chunk = f"""aggregate(slice(g, c * {CHUNK} + 1, {CHUNK}),
        struct(0L AS at, cast(array() AS {PLACES}) AS out),
        (s, x) -> struct(s.at + x.gap + x.len AS at, concat(s.out, array(struct(
            s.at + x.gap AS start, s.at + x.gap + x.len AS stop))) AS out))"""
    folded = f"transform(sequence(0, (size(g) - 1) div {CHUNK}), c -> {chunk})"
    # Each chunk with the words before it.
    moved = """flatten(aggregate(folded,
        struct(0L AS at, cast(array() AS array<array<struct<start:bigint,stop:bigint>>>) AS out),
        (s, c) -> struct(s.at + c.at AS at, concat(s.out, array(transform(c.out,
            p -> struct(p.start + s.at AS start, p.stop + s.at AS stop)))) AS out)).out)"""
    bound = f"transform(array({folded}), folded -> {moved})[0]"
    return f"""CASE WHEN {text} RLIKE {pattern}
        THEN transform(array({gaps}), g -> {bound})[0] ELSE cast(array() AS {PLACES}) END"""


RULES_TYPE = (
    "array<struct<keyword:string,rules:array<struct<rank:int,label:string,pattern:string,level:int,"
    "weight:double,base:boolean>>>>"
)


def _rule_list(own: list[Rule]) -> Column:
    """The rules by keyword, as a constant."""
    by_keyword: dict[str, list[dict]] = {}
    for i, r in enumerate(own):
        by_keyword.setdefault(r.keyword, []).append({"rank": i, **asdict(r)})
    listed = json.dumps([{"keyword": k, "rules": v} for k, v in by_keyword.items()])
    return F.from_json(F.lit(listed), RULES_TYPE)


# Walk: the furthest end per level, the labels kept, the best weight, the number kept.
_WALK = f"""aggregate(hits,
    struct(array_repeat(-1L, {LEVELS}) AS ends, cast(array() AS array<string>) AS labels,
        0.0D AS score, 0L AS n),
    (s, h) -> IF(array_max(slice(s.ends, 1, h.level + 1)) >= h.stop, s, struct(
        transform(s.ends, (e, i) -> IF(i = h.level, greatest(e, h.stop), e)) AS ends,
        IF(array_contains(s.labels, h.label), s.labels, concat(s.labels, array(h.label))) AS labels,
        greatest(s.score, h.weight) AS score, s.n + 1 AS n)))"""


def scan(docs: DataFrame, own: list[Rule] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, per row of ``docs(text, ..)``: ``n_words, n_base, first_word,
    last_word, base_labels, labels, score, n_kept, detections``.

    ``detections`` are the matches of all rules by place (``start, stop`` in words, ``label``,
    ``level``, ``base``); ``labels`` has the base labels and those of matches that are not
    suppressed, ``score`` the largest weight among both (0 without a match), ``n_kept`` the
    number of matches not suppressed. Base phrases are reported whatever contains them.

    A null, empty or wordless text has 0 words, empty label strings and score 0. Repeated
    rows are scanned each for itself; an empty table gives an empty result; columns other
    than ``text`` and ``keep`` are not read. A text of any length is scanned whole, in time
    about proportional to its length and its matches. Of rules that match the same words at the same level, the first one counts.
    """
    own = rules() if own is None else own
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), NOT_WORD, "  "))
    df = docs.select(F.struct(*keep).alias("_keep"), F.inline(F.array(F.struct(text.alias("_t")))))
    low = F.concat(F.lit(" "), F.lower("_t"), F.lit(" "))
    df = evaluate_once(df, low.alias("_low"))
    # lower() changes more letters than A-Z, so it may only pass too many texts.
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains("_low", F.lit(spaced(a)))
    exact = F.when(gate, F.concat(F.lit(" "), lower_ascii(F.col("_t")), F.lit(" ")))
    n_words = F.when(F.col("_t") == "", F.lit(0)).otherwise(F.expr(_words("_t")) + 1)
    df = df.select(
        "_keep", F.inline(F.array(F.struct(n_words.cast("bigint").alias("n_words"), exact.alias("_t"))))
    )
    one = f"""transform({places('_t', 'r.pattern')}, p -> struct(p.start AS start, -p.stop AS back,
        r.level AS level, r.rank AS rank, p.stop AS stop, r.label AS label, r.weight AS weight, r.base AS base))"""
    hits = F.expr(
        f"""array_sort(flatten(flatten(transform(filter(_rules, k -> contains(_t, k.keyword)),
            k -> transform(k.rules, r -> {one})))))"""
    )
    none = F.expr(
        "cast(array() AS array<struct<start:bigint,back:bigint,level:int,rank:int,stop:bigint,"
        "label:string,weight:double,base:boolean>>)"
    )
    df = df.withColumn("_rules", F.when(F.col("_t").isNotNull(), _rule_list(own)))
    found = F.when(F.col("_t").isNotNull(), hits).otherwise(none).alias("hits")
    df = df.select("_keep", "n_words", F.inline(F.array(F.struct(found))))
    df = evaluate_once(df, F.expr("filter(hits, h -> h.base)").alias("base"), F.expr(_WALK).alias("walk"))
    return df.select(
        "_keep.*",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.expr("array_min(base.start)").alias("first_word"),
        F.expr("array_max(base.start)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base.label, walk.labels)), ',')").alias("labels"),
        F.expr("greatest(walk.score, coalesce(array_max(base.weight), 0.0D))").alias("score"),
        F.expr("walk.n").alias("n_kept"),
        F.expr("transform(hits, h -> struct(h.start, h.stop, h.label, h.level, h.base))").alias("detections"),
    )


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def statement(own: list[Rule] | None = None) -> str:
    """The same result for DuckDB."""
    own = rules() if own is None else own
    listed = ",\n    ".join(
        f"({i}, {_text(r.label)}, {_text(r.keyword)}, {_text(r.pattern)}, {r.level}, {r.weight}::DOUBLE, {r.base})"
        for i, r in enumerate(own)
    )
    ends = " ".join(
        f"WHEN {k} THEN max(stop) FILTER (level <= {k}) OVER earlier" for k in range(LEVELS)
    )
    return rf"""
WITH rules(rank, label, keyword, pattern, level, weight, base) AS (VALUES
    {listed}
), d AS (
  SELECT row_number() OVER () AS row, doc_id, trim(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS t FROM documents
), w AS (
  SELECT row, doc_id, ' ' || t || ' ' AS t,
    CASE WHEN t = '' THEN 0 ELSE (length(t) - length(replace(t, ' ', ''))) // 2 + 1 END AS n_words FROM d
), m AS (
  SELECT row, r.*, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps
  FROM w JOIN rules r ON contains(t, keyword) AND regexp_matches(t, pattern)
), p AS (
  SELECT row, rank, label, level, weight, base, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM m
), q AS (
  SELECT *, (length(gaps[i]) - length(replace(gaps[i], ' ', ''))) // 2 AS gap,
    (length(found[i]) - length(replace(found[i], ' ', ''))) // 2 AS len FROM p
), h AS (
  SELECT row, rank, label, level, weight, base, len,
    sum(gap + len) OVER (PARTITION BY row, rank ORDER BY i) - len AS start,
    sum(gap + len) OVER (PARTITION BY row, rank ORDER BY i) AS stop FROM q
), k AS (
  SELECT *, coalesce(CASE level {ends} END, -1) < stop AS kept FROM h
  WINDOW earlier AS (PARTITION BY row ORDER BY start, stop DESC, level, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT row, count(*) FILTER (base) AS n_base,
    min(start) FILTER (base)::BIGINT AS first_word, max(start) FILTER (base)::BIGINT AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels,
    max(weight) FILTER (base OR kept) AS score
  FROM k GROUP BY row
)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN f USING (row)
"""


SQL = statement()
