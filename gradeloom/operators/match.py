"""Feedback similarity with token embeddings from a pluggable encoder."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.hashing import text_hash
from gradeloom.operators.labels import quoted
from gradeloom.session import Scratch, materialize

# texts -> one (tokens x width) array per text
Encoder = Callable[[Sequence[str]], Sequence[np.ndarray]]

# The filters of text hashes have at most 2 ** 28 bits (32 MB) each, in rows of 2 ** 12 words.
MAX_FILTER_DIGITS = 28
ROW_DIGITS = 12
# Texts that occur more than once are shuffled in shares of about 1 / SHARES of all texts.
SHARES = 6


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def _best(a: np.ndarray, b: np.ndarray, chunk: int = 1024) -> tuple[float, float]:
    """Mean over the rows of ``a`` of the best cosine with a row of ``b``, and the reverse."""
    if len(a) == 0 or len(b) == 0:
        return 0.0, 0.0
    a, b = _unit(a), _unit(b)
    own, other = [], np.full(len(b), -np.inf)
    for i in range(0, len(a), chunk):
        cosines = a[i : i + chunk] @ b.T
        own.append(cosines.max(axis=1))
        np.maximum(other, cosines.max(axis=0), out=other)
    return float(np.concatenate(own).mean()), float(other.mean())


def _packed(v: np.ndarray) -> bytes:
    """Doubles byte by byte, all first bytes first, compressed: vectors are much larger than
    their text, and are moved to each text they are compared with."""
    return pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpacked(vectors: bytes, tokens: int, width: int) -> np.ndarray:
    if not tokens * width:
        return np.empty((0, 0))
    planes = np.frombuffer(pa.decompress(vectors, tokens * width * 8, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.float64).reshape(tokens, width)


def encode_texts(
    texts: DataFrame, encoder_factory: Callable[[], Encoder], batch: int = 64
) -> DataFrame:
    """``text_hash, vectors, tokens, width`` of every row of ``texts(text_hash, text)``: the token
    vectors as doubles, packed. The encoder is built once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_factory()
        for own in batches:
            for i in range(0, own.num_rows, batch):
                part = own.slice(i, batch)
                got = list(encode(part.column(1).to_pylist()))
                if len(got) != part.num_rows:
                    raise ValueError(f"the encoder gave {len(got)} results for {part.num_rows} texts")
                got = [np.ascontiguousarray(v, np.float64) for v in got]
                got = [v if v.ndim == 2 else np.empty((0, 0)) for v in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([_packed(v) if v.size else b"" for v in got], pa.binary()),
                        pa.array([v.shape[0] for v in got], pa.int32()),
                        pa.array([v.shape[1] for v in got], pa.int32()),
                    ],
                    ["text_hash", "vectors", "tokens", "width"],
                )

    return texts.select("text_hash", "text").mapInArrow(
        run, "text_hash binary, vectors binary, tokens int, width int"
    )


def _pair_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in batches:
        ph, gh, *columns = own.columns
        sides = zip(*[c.to_pylist() for c in columns])
        scores = [_best(_unpacked(*row[:3]), _unpacked(*row[3:])) for row in sides]
        yield pa.RecordBatch.from_arrays(
            [
                ph, gh,
                pa.array([s[0] for s in scores], pa.float64()),
                pa.array([s[1] for s in scores], pa.float64()),
            ],
            ["_ph", "_gh", "precision", "recall"],
        )


def _places(bits: int) -> tuple[Column, list[Column]]:
    """The row of a filter of so many bits that ``key`` belongs to, and its two bits in the row."""
    width = 6 + ROW_DIGITS
    row = F.col("key").bitwiseAND(F.lit((bits >> width) - 1))
    return row, [F.shiftrightunsigned("key", n).bitwiseAND(F.lit((1 << width) - 1)) for n in (28, 46)]


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def _filters(needed: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """Two filters of ``bits`` bits, of the ``key`` of either table, as rows of ``needed`` and
    ``repeated`` words. Each passes its own keys and by chance some others."""
    none = needed.sparkSession.range(bits >> 6).select(
        F.shiftright("id", ROW_DIGITS).alias("row"),
        F.col("id").bitwiseAND(F.lit((1 << ROW_DIGITS) - 1)).cast("int").alias("at"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("needed", "repeated")],
    )
    row, places = _places(bits)

    def words(keys: DataFrame, name: str) -> DataFrame:
        own = keys.select(row.alias("row"), F.explode(F.array(*places)).alias("place"))
        own = own.select("row", _word(F.col("place")).alias("at"), F.expr("shiftleft(1L, int(place & 63))").alias(name))
        return none.where("false").unionByName(own, allowMissingColumns=True)

    each = none.unionByName(words(needed, "needed")).unionByName(words(repeated, "repeated"))
    each = each.groupBy("row", "at").agg(F.bit_or("needed").alias("needed"), F.bit_or("repeated").alias("repeated"))
    rows = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "needed", "repeated"))).alias("x"))
    return rows.selectExpr("row", "x.needed AS needed", "x.repeated AS repeated")


def each_once(texts: DataFrame, needed: DataFrame, tables: Scratch) -> list[DataFrame]:
    """The texts whose ``text_hash`` is in ``needed``, each one once, and by chance some others,
    none of them twice: several parts of ``text_hash, text``, to be written one after the other.

    Only hashes are counted. Two filters tell which texts are needed and which may occur more than
    once. A text that surely occurs once is taken where it is, in the last part; the others meet by
    their hash, a share of them in each part before, so that only that share is shuffled at a time.
    The more texts have to move, the more shares there are.
    More than 16 million hashes make the filters pass more by chance; then more is moved and
    encoded, nothing is lost.
    """
    key = F.xxhash64("text_hash").alias("key")
    needed = tables.save(needed.select(key).distinct(), "needed")
    in_task = texts.groupBy(key, F.spark_partition_id().alias("task")).count()
    counts = in_task.groupBy("key").agg(F.sum("count").alias("n"), F.count("*").alias("tasks"))
    counts = tables.save(counts, "counts")
    repeated = counts.where("n > 1")
    moved = repeated.join(needed, "key", "left_semi").agg(F.sum("tasks")).first()[0] or 0
    shares = max(1, math.ceil(SHARES * moved / (counts.agg(F.sum("tasks")).first()[0] or 1)))
    most = max(needed.count(), repeated.count())
    digits = max((16 * most).bit_length(), 6 + ROW_DIGITS)
    bits = 1 << min(digits, MAX_FILTER_DIGITS)
    words = F.broadcast(tables.save(_filters(needed, repeated.select("key"), bits), "filters"))
    row, places = _places(bits)

    def passes(name: str) -> Column:
        first, second = [F.getbit(F.get(words[name], _word(p)), p.bitwiseAND(F.lit(63)).cast("int")) for p in places]
        return (first == 1) & (second == 1)

    texts = texts.select("text_hash", F.coalesce("text", F.lit("")).alias("text"), key)
    own = (row == words["row"]) & passes("needed")
    several = texts.join(words, own & passes("repeated"), "left_semi")
    several = [several.where(F.pmod("key", F.lit(shares)) == i) for i in range(shares)]
    # Equal texts have equal hashes, so the group is the text.
    parts = [share.groupBy("text_hash").agg(F.first("text").alias("text")) for share in several]
    single = texts.join(words, own & ~passes("repeated"), "left_semi")
    return [*parts, single.select("text_hash", "text")]


def embedding_match(
    traits: DataFrame,
    encoder_factory: Callable[[], Encoder],
    batch: int = 64,
    texts: DataFrame | None = None,
    encoded: Callable[[], None] | None = None,
) -> DataFrame:
    """Add ``precision``, ``recall`` and ``f1`` of ``pred_text`` against ``gt_text``.

    Every distinct text is encoded once, however many systems are compared with it: texts are
    known by their SHA-256, one pass of the encoder fills a table of vectors, and pairs of
    texts, each scored once, read that table. A null text counts as an empty one.

    With ``texts`` (``text_hash, text``, any number of rows for a text) the rows have ``pred_hash``
    and ``gt_hash``, as of ``hashing.text_hash``, in place of the texts. ``encoded`` is called when
    neither ``traits`` nor ``texts`` will be read again.
    """
    names = [c for c in traits.columns if c not in ("precision", "recall", "f1")]
    with Scratch(traits.sparkSession) as tables:
        if texts is None:
            hashes = {out: text_hash(F.col(c)) for out, c in (("_ph", "pred_text"), ("_gh", "gt_text"))}
            rows = materialize(traits.select(*quoted(names)).withColumns(hashes), "texts-to-match")
            ph, gh = "_ph", "_gh"
            texts = rows.selectExpr("_ph AS text_hash", "pred_text AS text").unionByName(
                rows.selectExpr("_gh AS text_hash", "gt_text AS text")
            )
        else:
            rows = materialize(traits.select(*quoted(names)), "pairs-to-match")
            ph, gh = "pred_hash", "gt_hash"
        pairs = tables.save(rows.select(F.col(ph).alias("_ph"), F.col(gh).alias("_gh")).distinct(), "pairs")
        needed = pairs.select(F.explode(F.array("_ph", "_gh")).alias("text_hash"))
        parts = each_once(texts, needed, tables)
        parts = [tables.save(encode_texts(own, encoder_factory, batch), "vectors") for own in parts]
        vectors = reduce(DataFrame.unionByName, parts)
        if encoded:
            encoded()
        for side in ("_ph", "_gh"):
            own = [F.col(c).alias(f"{side}_{c}") for c in ("vectors", "tokens", "width")]
            pairs = pairs.join(vectors.select(F.col("text_hash").alias(side), *own), side)
        columns = [f"{side}_{c}" for side in ("_ph", "_gh") for c in ("vectors", "tokens", "width")]
        scored = pairs.select("_ph", "_gh", *columns).mapInArrow(
            _pair_scores, "_ph binary, _gh binary, precision double, recall double"
        )
        scored = materialize(scored, "pair-scores")
    same = (rows[ph] == scored["_ph"]) & (rows[gh] == scored["_gh"])
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    kept = [rows[c] for c in quoted(names)]
    return rows.join(scored, same).select(*kept, "precision", "recall", f1.alias("f1"))
