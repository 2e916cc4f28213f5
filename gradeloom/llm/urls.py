"""URL rules: a blocked Bloom filter of the listed canonical keys, then an exact hash join.

A rule ``(host, path, action)`` covers a host with all its subdomains, for paths that start
with the rule's. A URL's candidate keys are its host suffixes, each with the path prefixes
whose length occurs in the list. The filter decides inside the scan which candidates may be
listed; only those go on to the join with the list, which takes out false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import dense_words, lower_ascii, save

BLOCK_WORDS = 8  # a block is eight 64-bit words, one cache line; a key sets one bit in each
MAX_BLOCKS = 1 << 18  # 16 MB: the filter's size bound; a longer list only passes more
KEYS_PER_BLOCK = 32
_ROTATE = (0, 6, 12, 18, 24, 30, 36, 42)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(blocks: int) -> str:
    return f"int(pmod(xxhash64(key, 1), {blocks}))"


def bloom_words(rules: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter: ``blocks * BLOCK_WORDS`` longs, combined by OR per word."""
    hit = rules.select(F.concat("host", "path").alias("key")).selectExpr(
        f"{_block(blocks)} AS block", "xxhash64(key, 2) AS h"
    )
    words = hit.select(
        F.posexplode(
            F.array(
                *[F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {r}) & 63))") for r in _ROTATE]
            )
        ).alias("i", "bit"),
        "block",
    )
    words = words.select((F.col("block") * BLOCK_WORDS + F.col("i")).cast("bigint").alias("w"), F.col("bit").alias("b"))
    return dense_words(words, blocks * BLOCK_WORDS)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages(page_id, url)``.

    ``rules(host, path, action)``: hosts in lower case. The longest fitting rule gives the
    verdict; of equal rules the smallest action. A URL without a fitting rule gets
    ``default``. Rows with a null ``host``, ``path`` or ``action`` in the list are no rules.
    A null URL or one without ``://`` has an empty host and path and fits none. Repeated
    pages give repeated rows; other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    listed = (
        rules.select("host", "path", "action")
        .where("host <> '' AND path IS NOT NULL AND action IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
    )
    # The list is read several times below; its summary is one row.
    shape = listed.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    urls = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    if not shape["n"]:
        return urls.select(
            "*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * KEYS_PER_BLOCK < shape["n"]:
        blocks *= 2
    bits = save(bloom_words(listed, blocks), "url-bloom")

    lengths = ", ".join(str(n) for n in shape["lengths"])
    urls = urls.withColumns(
        {
            "row": F.monotonically_increasing_id(),
            # The last labels of the host, no more than the longest listed host has.
            "labels": F.expr(
                f"slice(split(host, '[.]'), -least(size(split(host, '[.]')), {shape['labels']}),"
                f" {shape['labels']})"
            ),
        }
    )
    urls = urls.withColumn(
        "keys",
        F.expr(
            f"""IF(host = '', array(), flatten(transform(sequence(1, size(labels)), i ->
            transform(filter(array({lengths}), n -> n <= length(path)), n ->
            struct(array_join(slice(labels, i, size(labels)), '.') AS host,
            left(path, n) AS path)))))"""
        ),
    )
    urls = urls.withColumn("bloom", bits.scalar())
    tests = " AND ".join(
        f"get(bloom, b * {BLOCK_WORDS} + {i}) & shiftleft(1L, int(shiftrightunsigned(h, {r}) & 63)) <> 0"
        for i, r in enumerate(_ROTATE)
    )
    possible = F.expr(
        f"""transform(filter(transform(keys, k -> struct(k AS k,
        {_block(blocks).replace('key', 'concat(k.host, k.path)')} AS b,
        xxhash64(concat(k.host, k.path), 2) AS h)),
        x -> {tests.replace('b *', 'x.b *').replace('(h,', '(x.h,')}), x -> x.k)"""
    )
    urls = urls.select("row", "page_id", "host", "path", possible.alias("hits"))
    hits = urls.select("row", "page_id", "host", "path", F.explode_outer("hits").alias("k"))
    exact = listed.select(F.struct("host", "path").alias("k"), "action")
    joined = hits.join(exact, "k", "left")
    found = F.when(F.col("action").isNotNull(), F.struct(
        F.length(F.concat("k.host", "k.path")).alias("n"),
        F.concat("k.host", "k.path").alias("rule"),
        "action",
    ))
    return (
        joined.groupBy("row")
        .agg(
            F.first("page_id").alias("page_id"),
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.max(found).alias("best"),
        )
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


# The rules of the named query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fit AS (
  SELECT *,
    (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS a,
    (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS b,
    (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS c,
    (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS d
  FROM p
)
SELECT page_id, host, path,
  CASE WHEN a THEN 'example.net/en/' WHEN b THEN 'example.com/de/'
       WHEN c THEN 'org/fr/' WHEN d THEN 'net/' END AS rule,
  CASE WHEN a THEN 'allow' WHEN b THEN 'block' WHEN c THEN 'allow'
       WHEN d THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""
