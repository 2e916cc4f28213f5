"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is expected
``target / size`` times. Documents are laid out in a fixed order, their expected copies are
summed up, one offset is added, and a document is emitted once per whole number its sum
crosses. The order goes by size class, so that every class is drawn at the same rate and the
words taken come near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACE_WORD, save

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2  # a document is taken at most this many times
SEED = 42
OFFSET_LEVELS = 1024  # offsets are multiples of 1/1024: sums of whole rates stay exact


def word_size(text: Column) -> Column:
    """Number of runs of non-white-space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    cap: int = CAP,
) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``.

    The share is poured over the sources by weight. A source holds ``cap`` times its size at
    most; sources are filled in the order in which they reach that, and what is left is
    shared by the rest. All sums are whole numbers, with one division at the end.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(rank) - 1).withColumn(
        "weight", F.get(pick, F.col("rank") % len(weights)).cast("bigint")
    )
    # A source is full when the water level reaches size / weight. Whole-number keys: the
    # product of all distinct weights makes the quotient exact.
    product = 1
    for w in set(int(w) for w in weights):
        product *= w
    level = F.expr(f"source_size * {product} div weight")
    before = Window.orderBy(level, "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumns(
        {
            "full_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(every)
            - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "total": F.sum("source_size").over(every),
        }
    )
    # In hundredths of a word: what is left for this source and those that fill up later.
    left = F.expr(f"total * {share_percent} - full_before * {100 * cap}")
    own = F.expr(f"source_size * {100 * cap}")
    per = per.withColumns({"left": left, "own": own}).withColumn(
        "fills", F.expr("own * weight_left <= left * weight")
    )
    # From the first source that does not fill up, all share by weight.
    first = F.min(F.when(~F.col("fills"), F.struct(level.alias("l"), "rank", "left", "weight_left")))
    per = per.withColumn("open", first.over(every))
    shared = F.expr("open.left * weight / (100 * open.weight_left)")
    is_open = F.expr(f"(source_size * {product} div weight, rank) >= (open.l, open.rank)")
    return per.select(
        "source",
        "source_size",
        F.when(F.col("open").isNotNull() & is_open, shared)
        .otherwise(F.col("own") / 100)
        .cast("double")
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, text_hash, size, source, source_size, target, copies, taken`` per row.

    ``docs``: ``doc_id, text, source``; nothing else is read. A null source is a source of
    its own, the last in order. Null, empty and blank texts have size 0: they are drawn like
    the others and take no words. Repeated rows are drawn each for itself; which of several
    equal rows is drawn does not show in the result. An empty table gives an empty result.
    ``copies`` (0 .. ``cap``) is how often the mix holds the document.
    """
    sized = save(
        docs.select(
            "doc_id", "source", word_size(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ),
        "mix-sizes",
    )
    rows = sized.count()
    # The order inside a source: size class, then the hash, then what tells rows apart. A
    # bucket is a range of that order, so sums over buckets and inside them give the rank.
    digits = F.bin("size")
    buckets = max(1, int(rows**0.5) // 16)
    keyed = sized.withColumns(
        {
            "class": F.concat(
                F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 3)
            ),
            "h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        }
    ).withColumn(
        "bucket", F.expr(f"int(conv(left(h, 8), 16, 10) * {buckets}L div 4294967296L)")
    )
    spot = ["source", "class", "bucket"]
    totals = keyed.groupBy(*spot).agg(F.count("*").alias("n"))
    earlier = (
        Window.partitionBy("source")
        .orderBy("class", "bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(*spot, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    targets = source_targets(sized, weights, share_percent, cap)
    # One offset per source.
    unit = F.expr(
        f"conv(left(md5(concat('{seed}/', coalesce(concat('s', source), ''))), 8), 16, 10)"
        f" % {OFFSET_LEVELS} / {OFFSET_LEVELS}.0D"
    )
    plan = totals.alias("t").join(
        targets.alias("g"), F.expr("t.source <=> g.source")
    ).select(
        F.col("t.source").alias("source"), "class", "bucket", "before", "source_size", "target",
    ).withColumns(
        {
            "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
            "offset": unit,
        }
    )
    inside = Window.partitionBy(*spot).orderBy("h", "doc_id", "size", "text_hash")
    ranked = keyed.withColumn("i", F.row_number().over(inside))
    both = ranked.alias("r").join(
        save(plan, "mix-plan").alias("p"),
        F.expr("r.source <=> p.source AND r.class = p.class AND r.bucket = p.bucket"),
    )
    rank = F.col("before") + F.col("i")
    copies = F.least(
        F.floor(F.col("offset") + F.col("rate") * rank)
        - F.floor(F.col("offset") + F.col("rate") * (rank - 1)),
        F.lit(cap),
    ).cast("bigint")
    return both.select(
        "doc_id", "text_hash", "size", F.col("r.source").alias("source"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns as they are
    and ``copy`` (0, 1, ..). Where the documents have a column of that name, the number is in
    ``copy_``, or as many more underscores as it takes.

    Rows that are equal in doc_id, source and text are interchangeable: together they are taken
    as often as they are drawn. Texts of any length are only hashed and counted.
    """
    drawn = mix(docs, **settings).where("copies > 0")
    same = ["doc_id", "source", "text_hash"]
    drawn = drawn.select(*same, "copies").groupBy(*same).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")
    )
    # A document travels as one column, so that its columns meet no name of ours.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
    )
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    left = packed.withColumn("_n", number)
    pair = F.expr(
        "d.doc_id <=> m.doc_id AND d.source <=> m.source AND d.text_hash = m.text_hash"
    )
    times = F.expr("int(copies div rows + IF(_n <= copies % rows, 1, 0))")
    name = "copy"
    while name in docs.columns:
        name += "_"
    return (
        left.alias("d")
        .join(drawn.alias("m"), pair)
        .where("_n <= rows")
        .select("_row", F.explode(F.sequence(F.lit(0), times - 1)).alias("_copy"))
        .select("_row.*", F.col("_copy").alias(name))
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), w AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM d GROUP BY source
), w2 AS (
  SELECT *, [5, 2, 1][(r % 3 + 1)::INT] AS weight, sum(source_size) OVER () AS total FROM w
), w3 AS (
  SELECT *,
    coalesce(sum(source_size) OVER o, 0) AS full_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left,
    row_number() OVER (ORDER BY source_size * 10 // weight, r) AS pos
  FROM w2
  WINDOW o AS (ORDER BY source_size * 10 // weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), w4 AS (
  SELECT *, total * 150 - full_before * 200 AS lft FROM w3
), o AS (
  SELECT min_by(lft, pos) AS lft, min_by(weight_left, pos) AS weight_left, min(pos) AS pos
  FROM w4 WHERE source_size * 200 * weight_left > lft * weight
), g AS (
  SELECT source, source_size,
    CASE WHEN o.pos IS NOT NULL AND w4.pos >= o.pos
      THEN (o.lft * weight)::DOUBLE / (100 * o.weight_left)::DOUBLE
      ELSE (source_size * 2)::DOUBLE END AS target,
    CASE WHEN source_size = 0 THEN 0.0 ELSE
      (CASE WHEN o.pos IS NOT NULL AND w4.pos >= o.pos
        THEN (o.lft * weight)::DOUBLE / (100 * o.weight_left)::DOUBLE
        ELSE (source_size * 2)::DOUBLE END) / source_size::DOUBLE END AS rate,
    (('0x' || left(md5('{SEED}/' || coalesce('s' || source, '')), 8))::BIGINT % 1024) / 1024.0::DOUBLE AS off
  FROM w4 LEFT JOIN o ON true
), k AS (
  SELECT d.*, source_size, target, rate, off,
    row_number() OVER (PARTITION BY d.source
      ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || left(bin(size), 3),
      md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id, size) AS i
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(off + rate * i) - floor(off + rate * (i - 1)), 2) * size)::BIGINT AS taken
FROM k
"""
