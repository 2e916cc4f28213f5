"""Masked pseudo-likelihood scores of documents.

A small network sees the two words on either side of a place and predicts the word in it:
tanh of the summed position-wise embeddings, then a softmax over word classes and one over the
words of a class. It is trained in numpy in several rounds, each over documents of its own:
the documents of a round are dealt to parts by a hash of the row, every part makes one pass
from the shared parameters, and the parameters are averaged by words seen. The number of parts
follows the words, and a part's documents come in the order of their hash, so a score depends
on the rows alone, not on files, partitions or cores. A document's score is the sum of the log-probabilities of all its words, each
predicted from both sides.

The network's words and classes grow with the square root of the number of distinct words.
Words it has no number for share hashed places; such a word's probability is that of its place
times the word's share ``n(word) / n(place)``, so every word has one of its own and all of
them add up to 1. The shares come from a join of each chunk's distinct rare words with the counts
of all words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from gradeloom.llm import wordhash as W
from gradeloom.llm.common import Scratch, save, with_columns

LEAST_CLASSES = 32  # of a small table
WORDS = LEAST_CLASSES**2
EDGE = -1  # what stands beyond the ends of a text: the last row of an embedding
REACH, WIDTH = (-2, -1, 1, 2), 16
STEP, LEARN_STEP, RATE, ROUNDS = 16_384, 4_096, 0.15, 4
PART_WORDS, PER_PARAMETER = 1 << 19, 4  # words of a part, at least; also per parameter
GATHER = 1 << 17  # words whose contexts are laid out at once; a longer text stays whole
SPREAD = 1 << 20  # distinct words that a task holds before it passes counts on


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """Of the parameters of a network with so many classes of as many words."""
    return {
        "embed": (len(REACH), classes * classes + 1, WIDTH),
        "shift": (WIDTH,),
        "class": (WIDTH, classes),
        "class_bias": (classes,),
        "word": (classes, WIDTH, classes),
        "word_bias": (classes, classes),
    }


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of whole texts: word hashes and each text's first word."""
    data, offsets = W.text_bytes(column)
    for i, j in W.slices(offsets):
        own = W.lower_ascii(data[offsets[i] : offsets[j]])
        starts, ends, first = W.word_spans(own, offsets[i : j + 1] - offsets[i], W.NOT_SPACE)
        yield (W.word_hashes(own, starts, ends) if len(starts) else np.empty(0, np.uint64)), first


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, n`` of every word of all documents."""

    def merged(hs: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(hs), return_inverse=True)
        return h, np.bincount(at, np.concatenate(ns)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        ns: list[np.ndarray] = []
        for batch in batches:
            for h, _ in _tokens(batch.column(0)):
                u, n = np.unique(h, return_counts=True)
                hs.append(u)
                ns.append(n)
            if sum(map(len, hs)) > SPREAD:
                h, n = merged(hs, ns)
                hs, ns = [h], [n]
                if len(h) > SPREAD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
                    hs, ns = [], []
        if hs:
            h, n = merged(hs, ns)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    each = docs.select("text").mapInArrow(run, "h bigint, n bigint")
    return each.groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words get a number by rank; all others share hashed places.

    ``hashes`` are the words with a number, ``place_counts`` how often the others occur, place by
    place.
    """

    def __init__(self, hashes: list[int], place_counts: np.ndarray, classes: int):
        top = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(top)
        self.sorted, self.rank, self.classes = top[order], order, classes
        self.known = classes * classes - len(place_counts)
        self.place_logs = np.log(np.maximum(place_counts, 1))

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From ``vars`` of another: a broadcast holds plain arrays, which any worker reads."""
        own = cls.__new__(cls)
        vars(own).update(state)
        return own

    def ids(self, h: np.ndarray) -> np.ndarray:
        other = self.known + (h % np.uint64(len(self.place_logs))).astype(np.int64)
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.rank[at], other)


def class_count(distinct: int) -> int:
    """So many classes of as many words: twice the square root of the distinct words in all."""
    return max(LEAST_CLASSES, math.ceil(math.sqrt(2 * math.sqrt(distinct))))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``counts(h, n)`` of all words."""
    classes = class_count(counts.count())
    places = 1 << (classes * classes // 16).bit_length() - 1  # h's low bits name the place
    top = counts.orderBy(F.desc("n"), "h").limit(classes * classes - places).collect()
    place = F.col("h").bitwiseAND(F.lit(places - 1)).alias("place")
    rest = np.zeros(places, np.int64)
    for r in counts.groupBy(place).agg(F.sum("n").alias("n")).collect():
        rest[r["place"]] = r["n"]
    for r in top:
        rest[r["h"] & places - 1] -= r["n"]
    return Vocabulary([r["h"] for r in top], rest, classes)


def start_parameters(seed: int = 3, classes: int = LEAST_CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        k: (rng.standard_normal(s) * 0.1 if "bias" not in k and k != "shift" else np.zeros(s)).astype(np.float32)
        for k, s in shapes(classes).items()
    }


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids at each reach of every word, ``EDGE`` beyond its text; one row per reach."""
    pad = max(map(abs, REACH))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids)) + pad * (owner + 1)
    line = np.full(len(ids) + pad * (len(first) + 1), EDGE)
    line[at] = ids
    return np.stack([line[at + r] for r in REACH])


def _shifted(x: np.ndarray) -> np.ndarray:
    """The logarithms of the sums of exponentials down the columns of ``x``, from which the
    greatest are taken away in place: sums along the first axis run over whole rows."""
    x -= np.maximum.reduce(x, 0)
    return np.log(np.add.reduce(np.exp(x), 0))


def _passed(p: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray, learn: bool):
    """As ``forward``, but of the embeddings only the rows that have a gradient, and theirs."""
    n, classes, per_class = len(ids), len(p["word_bias"]), p["word_bias"].shape[1]
    cls, word = ids // per_class, ids % per_class
    # Words in order of their class, so that a class is a slice.
    order = np.argsort(cls.astype(np.int16), kind="stable")
    border = np.searchsorted(cls[order], np.arange(classes + 1))
    around, cls, word, column = around[:, order], cls[order], word[order], np.arange(n)
    hidden = p["embed"][0].take(around[0], 0)
    for k in range(1, len(REACH)):
        hidden += p["embed"][k].take(around[k], 0)
    hidden += p["shift"]
    np.tanh(hidden, out=hidden)
    of_class = p["class"].T @ hidden.T
    of_class += p["class_bias"][:, None]
    logs = _shifted(of_class)
    found = of_class[cls, column] - logs
    # One block per class, words of the class by places of the text, and where each word is in it.
    flat = np.empty(n * per_class, hidden.dtype)
    at = border[cls] * per_class + word * np.diff(border)[cls] + column - border[cls]
    word_logs, blocks = np.empty(n, hidden.dtype), []
    for c, (i, j) in enumerate(zip(border[:-1].tolist(), border[1:].tolist())):
        if i < j:
            d = flat[i * per_class : j * per_class].reshape(per_class, j - i)
            np.matmul(p["word"][c].T, hidden[i:j].T, out=d)
            d += p["word_bias"][c][:, None]
            word_logs[i:j] = _shifted(d)
            blocks.append((c, i, j, d))
    found += flat[at] - word_logs
    out = np.empty(n, found.dtype)
    out[order] = found
    if not learn:
        return out
    grad = {k: np.zeros_like(v) for k, v in p.items() if k != "embed"}
    of_class -= logs
    d = np.exp(of_class, out=of_class)
    d[cls, column] -= 1
    grad["class"], grad["class_bias"] = (d @ hidden).T, d.sum(1)
    back = (p["class"] @ d).T
    for c, i, j, d in blocks:
        d -= word_logs[i:j]
        np.exp(d, out=d)
    flat[at] -= 1
    for c, i, j, d in blocks:
        grad["word"][c], grad["word_bias"][c] = (d @ hidden[i:j]).T, np.add.reduce(d, 1)
        back[i:j] += (p["word"][c] @ d).T
    back = back * (1 - hidden * hidden)
    grad["shift"] = back.sum(0)
    narrow = np.int16 if classes * per_class < 1 << 15 else np.int32  # 16 bits sort faster
    rows = []
    for k in range(len(REACH)):
        by = np.argsort(around[k].astype(narrow), kind="stable")
        own = around[k][by]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows.append((own[start], np.add.reduceat(back.take(by, 0), start, axis=0) / n))
    return out, {k: g / n for k, g in grad.items()}, rows


def forward(p: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray, learn: bool = False):
    """The log-probability of each word; with ``learn`` also the gradients of their negative mean."""
    if not learn:
        return _passed(p, around, ids, False)
    out, grad, rows = _passed(p, around, ids, True)
    embed = np.zeros_like(p["embed"])
    for k, (own, g) in enumerate(rows):
        embed[k][own] = g
    return out, grad | {"embed": embed}


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def _unpack(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(classes).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def learn(p: dict[str, np.ndarray], parts: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> int:
    """One pass of steps over ``(contexts, ids)``, in place; rates shrink per parameter with
    the gradients it has had. The number of words seen."""
    had = {k: np.full_like(v, 1e-6) for k, v in p.items()}

    def step(x: np.ndarray, squares: np.ndarray, g: np.ndarray) -> None:
        squares += g * g
        g *= rate
        g /= np.sqrt(squares)
        x -= g

    seen = 0
    for around, ids in parts:
        for i in range(0, len(ids), LEARN_STEP):
            _, grad, rows = _passed(p, around[:, i : i + LEARN_STEP], ids[i : i + LEARN_STEP], True)
            # A row without a gradient stays as it is.
            for x, squares, (own, g) in zip(p["embed"], had["embed"], rows):
                new, sums = x.take(own, 0), squares.take(own, 0)
                step(new, sums, g)
                x[own], squares[own] = new, sums
            for k, g in grad.items():
                step(p[k], had[k], g)
        seen += len(ids)
    return seen


def _averaged(sums: DataFrame) -> DataFrame:
    """Add up ``total, words`` in ever fewer tasks: each takes in about 16 others."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = None, 0
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, np.float64)
                total = x.copy() if total is None else total + x
                words += n
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total.tobytes()], pa.binary()), pa.array([words])], ["total", "words"]
            )

    n = sums.count()
    while n > 1:
        n = -(-n // 16)
        sums = sums.repartition(n).mapInArrow(add, "total binary, words bigint")
    return sums


def _numbered(docs: DataFrame, keep: tuple[str, ...], words: Vocabulary) -> DataFrame:
    """``key, ids`` of every text with words: a hash of the row and the numbers of its words."""
    named = [c for c in keep if isinstance(docs.schema[c].dataType, (IntegralType, StringType))]
    shared = docs.sparkSession.sparkContext.broadcast(vars(words))
    kind = _id_type(words.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.of(shared.value)
        for batch in batches:
            row = 0
            for h, first in _tokens(batch.column(1)):
                raw, border = words.ids(h).astype(kind).tobytes(), first * kind().itemsize
                own = [raw[i:j] or None for i, j in zip(border[:-1].tolist(), border[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(own)), pa.array(own, pa.binary())], ["key", "ids"]
                )
                row += len(own)

    rows = docs.select(F.xxhash64(*named, F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "key bigint, ids binary").where("ids IS NOT NULL")


def _id_type(classes: int) -> type:
    return np.int16 if classes * classes < 1 << 15 else np.int32


def _gathered(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``contexts, ids`` of some texts at a time."""
    held: list[np.ndarray] = []

    def laid_out() -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(held).astype(np.int64)
        return contexts(ids, np.cumsum([0, *map(len, held)])), ids

    size = 0
    for ids in texts:
        held.append(ids)
        size += len(ids)
        if size >= GATHER:
            yield laid_out()
            held, size = [], 0
    if held:
        yield laid_out()


def train(
    docs: DataFrame, keep: tuple[str, ...], words: Vocabulary, total: int, rounds: int = ROUNDS
) -> dict[str, np.ndarray]:
    """Parameters after one pass over all documents, averaged after each of ``rounds`` shares.

    ``total``: the words of all texts. Rows that agree in ``keep`` and text share a part; other
    copies of a text are spread over all parts.
    """
    p = start_parameters(classes=words.classes)
    if not total:
        return p
    least = max(PART_WORDS, PER_PARAMETER * sum(map(np.size, p.values())))
    parts = max(1, math.ceil(total / rounds / least))
    kind = _id_type(words.classes)
    sc = docs.sparkSession.sparkContext
    with Scratch(docs.sparkSession) as scratch:
        of_row = F.expr(f"int(pmod(key, {rounds}))"), F.expr(f"int(pmod(shiftright(key, 8), {parts}))")
        rows = _numbered(docs, keep, words).select(of_row[0].alias("turn"), of_row[1].alias("part"), "key", "ids")
        rows = scratch.save(rows, "lm-numbered")
        for turn in range(rounds):
            shared, rate = sc.broadcast(p), RATE / (1 + turn)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                start = shared.value
                each = (
                    (part, np.frombuffer(raw.as_py(), kind))
                    for batch in batches
                    for part, raw in zip(batch.column(0).to_pylist(), batch.column(1))
                )
                for _, texts in groupby(each, key=itemgetter(0)):
                    p = {k: v.copy() for k, v in start.items()}
                    n = learn(p, _gathered(ids for _, ids in texts), rate)
                    sums = _pack(p).astype(np.float64) * n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([sums.tobytes()], pa.binary()), pa.array([n])], ["total", "words"]
                    )

            own = rows.where(F.col("turn") == turn).repartitionById(parts, "part")
            own = own.sortWithinPartitions("part", "key").select("part", "ids")
            sums = scratch.save(own.mapInArrow(run, "total binary, words bigint"), "lm-sums")
            got = _averaged(sums).collect()
            if got:
                p = _unpack(np.frombuffer(got[0]["total"], np.float64) / got[0]["words"], words.classes)
    return p


def _packed(chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk, each with the numbers of its rare words, and one more row with
    the distinct rare words of all of them in the order of these numbers."""
    kept, n, sums, rare, per = zip(*held)
    h, at = np.unique(np.concatenate(rare), return_inverse=True)
    raw = at.astype(np.int32).tobytes()
    border = (4 * np.append(0, np.cumsum(np.concatenate(per)))).tolist()
    kept = pa.concat_arrays(kept)
    rows = len(kept)
    names = ["kept", "chunk", "is_row", "n_words", "sum", "rare", "words"]
    yield pa.RecordBatch.from_arrays(
        [
            kept,
            pa.array(np.full(rows, chunk)),
            pa.array(np.ones(rows, bool)),
            pa.array(np.concatenate(n)),
            pa.array(np.concatenate(sums)),
            pa.array([raw[i:j] for i, j in zip(border[:-1], border[1:])], pa.binary()),
            pa.nulls(rows, pa.list_(pa.int64())),
        ],
        names,
    )
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(1, kept.type),
            pa.array([chunk]),
            pa.array([False]),
            pa.nulls(1, pa.int64()),
            pa.nulls(1, pa.float64()),
            pa.nulls(1, pa.binary()),
            pa.array([h.view(np.int64)], pa.list_(pa.int64())),
        ],
        names,
    )


def _scored(docs: DataFrame, keep: tuple[str, ...], words: Vocabulary, total: int) -> DataFrame:
    """Chunks of scored rows as of ``_packed``; ``sum`` is still without the rare words' counts."""
    shared = docs.sparkSession.sparkContext.broadcast((train(docs, keep, words, total), vars(words)))
    frame = docs.select(F.struct(*keep).alias("kept"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, words = shared.value[0], Vocabulary.of(shared.value[1])
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            row = 0
            for h, first in _tokens(batch.column(1)):
                total, rare = np.zeros(len(h) + 1), np.zeros(len(h) + 1, np.int64)
                found = h
                if len(h):
                    ids = words.ids(h)
                    around = contexts(ids, first)
                    each = np.concatenate([
                        forward(p, around[:, i : i + STEP], ids[i : i + STEP])
                        for i in range(0, len(ids), STEP)
                    ]).astype(np.float64)
                    other = ids >= words.known
                    each[other] -= words.place_logs[ids[other] - words.known]
                    np.cumsum(each, out=total[1:])
                    np.cumsum(other, out=rare[1:])
                    found = h[other]
                rows = len(first) - 1
                held.append((
                    batch.column(0).slice(row, rows), np.diff(first), total[first[1:]] - total[first[:-1]],
                    found, rare[first[1:]] - rare[first[:-1]],
                ))
                row += rows
                size += len(found) + rows
                if size > SPREAD:
                    yield from _packed(chunk, held)
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield from _packed(chunk, held)

    extra = "chunk bigint, is_row boolean, n_words bigint, sum double, rare binary, words array<bigint>"
    kept = StructField("kept", frame.schema["kept"].dataType, True)  # the chunk's words have none
    return frame.mapInArrow(run, StructType([kept, *StructType.fromDDL(extra).fields]))


def _with_counts(rows: pa.Table, logs: pa.Table) -> pa.Table:
    """The rows of a chunk, with the logarithms of their rare words' counts added."""
    place = logs["place"].to_numpy()
    value = np.zeros(int(place.max()) + 1 if len(place) else 1)
    value[place] = logs["log_n"].to_numpy()
    raw = rows["rare"].to_pylist()
    at = np.frombuffer(b"".join(raw), np.int32)
    owner = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
    # Words that occur once are not in ``logs``: the logarithm is 0.
    each = np.where(at < len(value), value[np.minimum(at, len(value) - 1)], 0.0)
    sums = rows["sum"].to_numpy() + np.bincount(owner, each, len(raw))
    return pa.table({"kept": rows["kept"], "n_words": rows["n_words"], "log_prob": pa.array(sums)})


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, n_words, log_prob, mean_log_prob`` per row of ``docs`` with a ``text``.

    Words are runs of non-white-space, A-Z lower-cased. Null, empty and blank texts have no
    words, a sum of 0 and a null mean. Repeated rows get the same score. An empty table gives
    an empty result. Vocabulary and network come from all documents; a text of any length is
    learned from and scored whole. The same rows in other files or partitions get the same
    scores, but for rounding.
    """
    counts = save(word_counts(docs), "lm-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    chunks = save(_scored(docs, keep, vocabulary(counts), total), "lm-scored")
    rare = chunks.where("NOT is_row").select(F.col("chunk").alias("of"), F.posexplode("words").alias("place", "h"))
    logs = rare.join(counts.where("n > 1").select("h", F.ln("n").alias("log_n")), "h").drop("h")
    rows = chunks.where("is_row").select("chunk", "kept", "n_words", "sum", "rare")
    scored = rows.groupBy("chunk").cogroup(logs.groupBy("of")).applyInArrow(
        _with_counts, with_columns(chunks, ("kept", "n_words"), "log_prob double")
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.select("kept.*", "n_words", "log_prob", mean.alias("mean_log_prob"))
