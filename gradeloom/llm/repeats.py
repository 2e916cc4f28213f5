"""Exact removal of repeated passages with suffix arrays.

A byte is removed if some ``LENGTH`` bytes around it also start earlier: in a document with a
smaller doc_id, or earlier in the same one. The corpus is dealt out by content, so that no
task sees more than a bounded share:

1. Every start of ``LENGTH`` bytes is filed under the smallest hash among its ``GRAM``-byte
   grams. Equal strings have equal hashes. Neighbouring starts with the same hash are one
   piece of text; a hash seen once leads to nothing.
2. Equal pieces are counted as one, with the first place where the piece stands. Everywhere
   else all of it is repeated.
3. Hashes with several different pieces (or one that repeats inside) go to tasks by hash; a
   suffix array over the pieces brings equal strings together and shows which starts of a
   piece stand earlier in another one.
4. Covered ranges are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as W
from gradeloom.llm.common import (
    Scratch, bitmap, bucket_count, in_bitmap, save, split, with_columns,
)
from gradeloom.llm.lyndon import suffix_array

LENGTH, GRAM = 100, 40
RUN = 4096  # a longer run of starts under one hash is cut into several pieces
TASK_BYTES = 1 << 20  # text of a task
TEXT_BYTES = 1 << 14  # text of one suffix array, unless pieces of one hash have more
HOT_PIECES = 4096  # more pieces under one hash are dealt out again, start by start
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n, span = len(h) - width + 1, 1
    while span * 2 <= width:
        h = np.minimum(h[: len(h) - span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[width - span : width - span + n])


def find_pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Pieces of a slice of texts: ``row, low, starts, hash, content hash, repeats inside``.

    ``low`` counts from the slice's begin. A piece has ``starts + length - 1`` bytes.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty > 0
    total, down = W.prefix_hash(data)
    h = W.mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    least = _sliding_min(h, length - gram + 1)
    n = len(least)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + length <= offsets[owner + 1]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    # Where the least gram leaves the window and an equal one takes over, it repeats inside.
    again = np.flatnonzero((h[: n - 1] == least[:-1]) & ~new[1:] & valid[1:])
    low = np.flatnonzero(new)
    run = np.add.reduceat(valid.astype(np.int64), low)
    inside = np.zeros(len(low), bool)
    inside[np.searchsorted(low, again, side="right") - 1] = True
    keep = run > 0
    low, run, inside = low[keep], run[keep], inside[keep]
    if len(run) and run.max() > RUN:
        parts = -(-run // RUN)
        first = np.repeat(np.append(0, np.cumsum(parts)[:-1]), parts)
        k = np.arange(parts.sum()) - first
        low = np.repeat(low, parts) + k * RUN
        run = np.minimum(np.repeat(run, parts) - k * RUN, RUN)
        inside = np.ones(len(low), bool) & np.repeat(inside | (parts > 1), parts)
    end = low + run + length - 1
    content = W.mix((total[end] - total[low]) * down[low] + run.astype(np.uint64))
    return owner[low], low, run, least[low], content, inside


def _hashes(docs: DataFrame) -> DataFrame:
    """``a, p``: hash and content hash of every piece. A piece that repeats inside counts as
    two different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(0))
            for i, j in W.slices(offsets):
                *_, a, p, inside = find_pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                a, p = np.append(a, a[inside]), np.append(p, ~p[inside])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(p.view(np.int64))], ["a", "p"]
                )

    return docs.select("text").mapInArrow(run, "a bigint, p bigint")


def _occurrences(docs: DataFrame, live: np.ndarray, several: np.ndarray) -> DataFrame:
    """``doc, place, low, starts, a, p, content`` of the pieces whose hash may be live; the
    content only where the hash may have several pieces."""
    shared = docs.sparkSession.sparkContext.broadcast((live, several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, several = shared.value
        for batch in batches:
            doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = W.text_bytes(batch.column(2))
            for i, j in W.slices(offsets):
                own = data[offsets[i] : offsets[j]]
                row, low, n, a, p, _ = find_pieces(own, offsets[i : j + 1] - offsets[i])
                on = in_bitmap(live, a)
                row, low, n, a, p = row[on], low[on], n[on], a[on], p[on]
                raw, text = own.tobytes(), []
                for s, size, many in zip(low.tolist(), n.tolist(), in_bitmap(several, a).tolist()):
                    text.append(raw[s : s + size + LENGTH - 1] if many else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[i + row]),
                        pa.array(place[i + row]),
                        pa.array(low - (offsets[i + row] - offsets[i])),
                        pa.array(n.astype(np.int32)),
                        pa.array(a.view(np.int64)),
                        pa.array(p.view(np.int64)),
                        pa.array(text, pa.binary()),
                    ],
                    ["doc", "place", "low", "starts", "a", "p", "content"],
                )

    return _placed(docs).select("doc", "place", "text").mapInArrow(
        run,
        "doc bigint, place bigint, low bigint, starts int, a bigint, p bigint, content binary",
    )


def _placed(docs: DataFrame) -> DataFrame:
    """Add ``doc``, the order of documents, and ``place``, which tells texts apart."""
    return docs.withColumns(
        {
            "doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST))),
            "place": F.xxhash64("doc_id", "text"),
        }
    )


def _offsets(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and offset of every start, piece after piece."""
    owner = np.repeat(np.arange(len(starts)), starts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)


def _runs(owner: np.ndarray, offset: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring starts that are ``on``."""
    at = np.flatnonzero(on)
    if not len(at):
        return at, at
    cut = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
    return at[np.append(True, cut)], at[np.append(cut, True)]


def earlier_starts(
    pieces: list[bytes], starts: np.ndarray, doc: np.ndarray, low: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """Which starts (piece after piece) have a string that stands earlier in these pieces, by
    a suffix array over them. A piece's place in the corpus is ``doc, low``."""
    raw = b"\0".join(pieces) + b"\0"
    text: list[int] = []
    for p in pieces:
        text += p
        text.append(-1)
    base = np.append(0, np.cumsum([len(p) + 1 for p in pieces]))[:-1]
    owner, offset = _offsets(starts)
    start_at = np.full(len(text), -1, np.int64)
    start_at[base[owner] + offset] = np.arange(len(owner))
    order = np.array(suffix_array(text))
    order = order[start_at[order] >= 0]
    same = [0]
    before = raw[order[0] : order[0] + length]
    for i in order[1:].tolist():
        now = raw[i : i + length]
        same.append(now != before)
        before = now
    group = np.cumsum(same)
    k = start_at[order]
    d, s = doc[owner[k]], low[owner[k]] + offset[k]
    by = np.lexsort((s, d, group))
    g, d, s, k = group[by], d[by], s[by], k[by]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    of = np.repeat(first, np.diff(np.append(first, len(g))))
    out = np.zeros(len(owner), bool)
    out[k] = (d != d[of]) | (s != s[of])
    return out


def covered_starts(
    pieces: list[bytes], hashes: np.ndarray, starts: np.ndarray, doc: np.ndarray, low: np.ndarray,
    length: int = LENGTH, text_bytes: int = TEXT_BYTES,
) -> Iterator[tuple[int, int, int]]:
    """``piece, first, last`` start, for runs of starts whose string stands earlier.

    Starts whose string has a hash of its own are left out. What remains of the pieces is
    collapsed where it is the same, the first place standing for all, and goes to suffix
    arrays of about ``text_bytes``, all pieces of a hash to the same.
    """
    starts = starts.astype(np.int64)
    owner, offset = _offsets(starts)
    size = np.array([len(p) for p in pieces])
    base = np.cumsum(size) - size
    total, down = W.prefix_hash(np.frombuffer(b"".join(pieces), np.uint8))
    at = base[owner] + offset
    string = W.mix((total[at + length] - total[at]) * down[at])
    _, number, count = np.unique(string, return_inverse=True, return_counts=True)
    begin, end = _runs(owner, offset, count[number] > 1)
    out = np.zeros(len(owner), bool)
    # What remains, by hash and then by text.
    rest: dict[tuple[int, bytes], list[int]] = {}
    for r, (i, j) in enumerate(zip(begin.tolist(), end.tolist())):
        p = owner[i]
        text = pieces[p][offset[i] : offset[j] + length]
        rest.setdefault((int(hashes[p]), text), []).append(r)
    batch: list[tuple[bytes, int]] = []

    def settle() -> None:
        if len(batch):
            rep = np.array([r for _, r in batch])
            own = owner[begin[rep]]
            n = end[rep] - begin[rep] + 1
            hit = earlier_starts([t for t, _ in batch], n, doc[own], low[own] + offset[begin[rep]], length)
            where, k = _offsets(n)
            out[begin[rep][where] + k] |= hit
            batch.clear()

    last, held = None, 0
    for (h, text), runs in sorted(rest.items(), key=lambda x: x[0][0]):
        if h != last and held >= text_bytes:
            settle()
            held = 0
        last = h
        place = [(doc[owner[begin[r]]], low[owner[begin[r]]] + offset[begin[r]]) for r in runs]
        first = min(range(len(runs)), key=place.__getitem__)
        for r, x in zip(runs, place):
            if x != place[first]:
                out[begin[r] : end[r] + 1] = True
        batch.append((text, runs[first]))
        held += len(text)
    settle()
    begin, end = _runs(owner, offset, out)
    yield from zip(owner[begin].tolist(), offset[begin].tolist(), offset[end].tolist())


def _sorted_runs(pieces: DataFrame) -> DataFrame:
    """``a, p, first, last``: covered starts of pieces ``(task, a, p, doc, low, skip, content,
    starts)``. ``skip`` starts were cut off before."""

    def run(table: pa.Table) -> pa.Table:
        a, p = table["a"].to_numpy(), table["p"].to_numpy()
        skip, starts = table["skip"].to_numpy(), table["starts"].to_numpy()
        got = covered_starts(
            table["content"].to_pylist(), a, starts, table["doc"].to_numpy(),
            table["low"].to_numpy() + skip,
        )
        got = np.array(list(got), np.int64).reshape(-1, 3)
        i = got[:, 0]
        return pa.table(
            {"a": a[i], "p": p[i], "first": got[:, 1] + skip[i], "last": got[:, 2] + skip[i]}
        )

    return pieces.groupBy("task").applyInArrow(run, "a bigint, p bigint, first bigint, last bigint")


def _tasks(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Deal pieces with content out to tasks of about ``TASK_BYTES`` of text. All pieces of
    a hash meet in one. A hash with very many is dealt out start by start instead,
    each start with its own string, by the string's hash; equal strings still meet."""
    size = pieces.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    tasks = bucket_count(size, TASK_BYTES)
    counts = pieces.groupBy("a").agg(F.count("*").alias("n")).where(f"n > {HOT_PIECES}")
    counts = scratch.save(counts, "rep-hot")
    marked = pieces.join(counts, "a", "left")
    cool = marked.where("n IS NULL").select(
        F.expr(f"concat('c', pmod(xxhash64(a), {tasks}))").alias("task"),
        "a", "p", "doc", "low", F.lit(0).cast("bigint").alias("skip"), "content", "starts",
    )
    hot = marked.where("n IS NOT NULL").select(
        "a", "p", "doc", "low", "n", "content", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("i")
    )
    string = F.expr(f"substring(content, i + 1, {LENGTH})")
    hot = hot.withColumn("content", string).select(
        F.expr(
            f"concat('h', hex(a), '/', pmod(xxhash64(content), n * {LENGTH} * 32 div {TASK_BYTES} + 1))"
        ).alias("task"),
        "a", "p", "doc", "low", F.col("i").cast("bigint").alias("skip"), "content",
        F.lit(1).alias("starts"),
    )
    return cool.unionByName(hot)


def covered(docs: DataFrame) -> DataFrame:
    """``doc, place, spans``: the merged byte ranges to remove, for documents that have any.
    Spans are arrays of ``start, stop``."""
    with Scratch(docs.sparkSession) as scratch:
        hashes = _hashes(docs).repartition("a").groupBy("a").agg(
            F.count("*").alias("n"), (F.min("p") != F.max("p")).alias("several")
        )
        live = scratch.save(hashes.where("n > 1").select("a", "several"), "rep-live")
        found = scratch.save(
            _occurrences(docs, bitmap(live, "a"), bitmap(live.where("several"), "a")), "rep-places"
        )
        pieces = scratch.save(
            found.groupBy("a", "p").agg(
                F.min(F.struct("doc", "low")).alias("at"),
                F.first("content").alias("content"),
                F.first("starts").alias("starts"),
            ).select("a", "p", "at.doc", "at.low", "content", "starts"),
            "rep-pieces",
        )
        runs = _sorted_runs(_tasks(pieces.where("content IS NOT NULL"), scratch))
        runs = runs.groupBy("a", "p").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
        known = scratch.save(
            pieces.select("a", "p", "doc", "low").join(runs, ["a", "p"], "left")
            .withColumnsRenamed({"doc": "doc0", "low": "low0"}),
            "rep-known",
        )
        each = found.drop("content").join(known, ["a", "p"])
        each = each.where("doc <> doc0 OR low <> low0 OR runs IS NOT NULL")
        ranges = each.select(
            "doc",
            "place",
            F.explode(
                F.expr(
                    f"""IF(doc <> doc0 OR low <> low0,
                    array(struct(low AS start, low + starts + {LENGTH - 1} AS stop)),
                    transform(runs, r -> struct(low + r.first AS start, low + r.last + {LENGTH} AS stop)))"""
                )
            ).alias("r"),
        )
        merged = F.expr(
            """aggregate(array_sort(collect_list(r)), CAST(array() AS array<struct<start: bigint, stop: bigint>>),
            (acc, x) -> IF(size(acc) > 0 AND element_at(acc, -1).stop >= x.start,
              concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start,
                greatest(element_at(acc, -1).stop, x.stop) AS stop))),
              concat(acc, array(x))))"""
        )
        return save(ranges.groupBy("doc", "place").agg(merged.alias("spans")), "rep-cover")


def with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in two parts: those without anything to remove, as they are, and the
    others with ``spans``. Only texts that may be in the second part are shuffled."""
    cover = covered(docs)
    key = F.xxhash64("doc", "place")
    sure, possible = split(_placed(docs).withColumn("k", key), cover.select(key.alias("k")), "k")
    other = possible.join(cover, ["doc", "place"], "left").drop("k", "doc", "place")
    return sure.drop("k", "doc", "place"), other


def keep(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(raw[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, raw[at:]])


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs(doc_id, text)``.

    A null text has no bytes; one shorter than ``LENGTH`` is kept whole. Rows without doc_id
    come last in the order, as one document. Rows that repeat doc_id and text are one
    document too: they get the same result and do not remove each other. Rows with the same
    doc_id and different texts are compared by start alone. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest, other = with_spans(docs.select("doc_id", "text"))
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    zero = F.lit(0).cast("bigint")
    whole = rest.select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), zero.alias("n_removed"),
        zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            spans = batch.column(2).to_pylist()
            kept = [keep(x, s) for x, s in zip(raw, spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, raw), pa.int64()),
                    pa.array([len(x) - len(y) for x, y in zip(raw, kept)], pa.int64()),
                    pa.array([len(s or ()) for s in spans], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    cut = other.select("doc_id", text.alias("text"), "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return whole.unionByName(cut)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``, and ``n_chars``, where
    there is one, made to fit. A character of which a byte goes, goes. A text that is all
    repeats becomes empty; its row stays. Other columns stay as they are."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    rest, other = with_spans(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t is None else keep(t.encode(), s).decode("utf-8", "ignore")
                for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "text"])

    cut = other.select("_row", "text", "spans").mapInArrow(run, with_columns(other, ["_row"], "text string"))
    new = cut.withColumn("_row", F.col("_row").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new = new.withColumn("_row", F.col("_row").withField("n_chars", F.coalesce(size, F.col("_row.n_chars"))))
    return rest.select("_row.*").unionByName(new.select("_row.*"))
