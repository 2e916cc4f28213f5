"""Benchmark decontamination by winnowing.

Of every window of ten words the smallest hash of its five-word grams is kept as the window's
fingerprint, so any shared run of ten words shares one. Fingerprints of the benchmark go into
a bitmap of fixed size; windows of documents that may be in it are joined with the benchmark's
windows by their words. Overlapping windows extend each hit to the whole shared run. A
benchmark item of fewer than ten words is one window, with its own hash as fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as W
from gradeloom.llm.common import bitmap, in_bitmap, save, with_columns

WINDOW, GRAM = 10, 5


def winnow(words: np.ndarray) -> np.ndarray:
    """The smallest gram hash of each window of ``WINDOW`` words."""
    grams = W.gram_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


def _windows(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which runs of ``length`` words lie inside one text; ``first``: texts' first words."""
    n = total - length + 1
    if n <= 0:
        return np.empty(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + length <= end


def _join(data: bytes, starts, ends, i: int, length: int) -> str:
    return b" ".join(data[starts[k] : ends[k]] for k in range(i, i + length)).decode()


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, length, print, window`` of all windows of ``items(item_id, text)``."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for row in range(batch.num_rows):
                own = W.lower_ascii(data[offsets[row] : offsets[row + 1]])
                starts, ends, _ = W.word_spans(own, np.array([0, len(own)]), W.ALNUM)
                n = len(starts)
                if not n:
                    continue
                words, raw = W.word_hashes(own, starts, ends), own.tobytes()
                size = min(n, WINDOW)
                prints = winnow(words) if n >= WINDOW else W.gram_hashes(words, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(prints), batch.schema[0].type),
                        pa.array([size] * len(prints), pa.int32()),
                        pa.array(prints.view(np.int64)),
                        pa.array([_join(raw, starts, ends, i, size) for i in range(len(prints))]),
                    ],
                    ["item_id", "length", "print", "window"],
                )

    return items.select("item_id", "text").mapInArrow(
        run, f"item_id {kind}, length int, print bigint, window string"
    )


_HIT = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("window", pa.string())])


def possible_hits(docs: DataFrame, keep: tuple[str, ...], lengths: list[int], bits: np.ndarray) -> DataFrame:
    """``*keep, row, n_words, hits`` per document, in one pass over the whole texts; ``hits``
    are the windows whose fingerprint may be one of the benchmark's."""
    frame = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, bits = TaskContext.get().partitionId() << 40, shared.value
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(len(keep)))
            counts: list[np.ndarray] = []
            hits: list[list] = []
            for i, j in W.slices(offsets):
                own = W.lower_ascii(data[offsets[i] : offsets[j]])
                starts, ends, first = W.word_spans(own, offsets[i : j + 1] - offsets[i], W.ALNUM)
                counts.append(np.diff(first))
                found: list[list] = [[] for _ in range(j - i)]
                hits += found
                if not len(starts):
                    continue
                words, raw = W.word_hashes(own, starts, ends), None
                for length in lengths:
                    prints = winnow(words) if length == WINDOW else W.gram_hashes(words, length)
                    maybe = np.flatnonzero(
                        in_bitmap(bits, prints) & _windows(first, length, len(words))
                    )
                    if not len(maybe):
                        continue
                    raw = raw or own.tobytes()
                    owner = np.searchsorted(first, maybe, side="right") - 1
                    for at, text in zip(maybe.tolist(), owner.tolist()):
                        found[text].append(
                            (at - int(first[text]), length, _join(raw, starts, ends, at, length))
                        )
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(keep))],
                    pa.array(np.arange(row, row + n)),
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                    pa.array(
                        [[dict(zip(("start", "length", "window"), h)) for h in x] for x in hits],
                        pa.list_(_HIT),
                    ),
                ],
                [*keep, "row", "n_words", "hits"],
            )
            row += n

    hit = "array<struct<start: bigint, length: bigint, window: string>>"
    return frame.mapInArrow(run, with_columns(docs, keep, f"row bigint, n_words bigint, hits {hit}"))


def find(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, n_words, n_hit, n_items, items_sha256, contaminated`` per row of
    ``docs(doc_id, text)`` against ``items(item_id, text)``.

    Null, empty and wordless texts have no words: such a document is never hit, such an item
    has no window. Items that share a window all count; an item_id that occurs twice counts
    once, and one that is null marks words but is not listed. Repeated documents are judged
    one by one. Other columns are not read.
    """
    known = save(item_windows(items), "bench-windows")
    lengths = [r[0] for r in known.select("length").distinct().orderBy("length").collect()]
    bits = bitmap(known, "print")
    rows = save(possible_hits(docs, keep, lengths, bits), "bench-hits")
    listed = save(
        known.groupBy("window").agg(F.collect_set("item_id").alias("items")), "bench-listed"
    )
    hits = rows.select("row", F.inline("hits")).join(listed, "window")
    runs = "array_sort(collect_list(struct(start, start + length AS stop)))"
    per_row = hits.groupBy("row").agg(
        F.expr(
            f"""aggregate({runs}, struct(0L AS n, 0L AS stop), (a, x) -> struct(
            a.n + greatest(0L, x.stop - greatest(x.start, a.stop)) AS n,
            greatest(a.stop, x.stop) AS stop), a -> a.n)"""
        ).alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    joined = F.coalesce(F.array_join(names, ","), F.lit(""))
    return rows.join(per_row, "row", "left").select(
        *keep,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bm AS (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bi AS (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bm),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM bi),
di AS (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i
  FROM d, (SELECT DISTINCT m FROM bm) WHERE len(w) >= m
), dw AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS x FROM di),
hit AS (SELECT r, dw.m, i, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.m = bw.m),
pos AS (SELECT DISTINCT r, i, m FROM hit),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM
  (SELECT r, unnest(range(i, i + m)) AS p FROM pos) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM
  (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN its USING (r)
"""
