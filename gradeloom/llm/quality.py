"""Quality scores by naive-Bayes support vectors.

A text's features are indicators of its byte trigrams, words and word pairs, hashed into a
fixed space. Each indicator is scaled by the log-count ratio of the two classes, a linear
model with hinge loss is fitted to the scaled indicators by dual coordinate descent, and a
logistic curve through out-of-fold margins turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as W
from gradeloom.llm.common import Scratch, with_columns

DIMENSIONS = 1 << 18
MAX_TRAIN_ROWS = 8_000  # bound of the labelled sample that is gathered for the fit
MAX_TRAIN_BYTES = 128 << 20  # and of its features
THRESHOLD = 0.3
HOLD_OUT = 5  # rows whose crc32(doc_id) is divisible by this are never learned from
PENALTY, EPOCHS, FOLDS, SMOOTH = 0.1, 8, 3, 1.0
REPEATS = 8  # a word said 2 .. REPEATS times in a row is a feature, whichever word it is


def _raw_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a slice of texts, repeats included, and their offsets by text."""
    mask = np.uint64(DIMENSIONS - 1)
    n = len(offsets) - 1
    parts, owners = [], []
    if len(data) >= 3:
        b = data.astype(np.uint32)
        grams = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
        sizes = np.maximum(np.diff(offsets) - 2, 0)
        inside = np.ones(len(grams), bool)
        for border in (offsets[1:-1] - 1, offsets[1:-1] - 2):
            inside[border[(border >= 0) & (border < len(grams))]] = False
        parts.append((grams[inside] >> np.uint32(14)).astype(np.int64))
        owners.append(np.repeat(np.arange(n), sizes))
    starts, ends, first = W.word_spans(data, offsets, W.NOT_SPACE)
    if len(starts):
        words = W.word_hashes(data, starts, ends)
        owner = np.repeat(np.arange(n), np.diff(first))
        parts.append((words & mask).astype(np.int64))
        owners.append(owner)
        pair, inside = W.gram_hashes(words, 2), owner[1:] == owner[:-1]
        parts.append((pair[inside] & mask).astype(np.int64))
        owners.append(owner[1:][inside])
        same = again = inside & (words[1:] == words[:-1])
        for times in range(2, REPEATS + 1):
            at = np.flatnonzero(same)
            parts.append(np.full(len(at), times, np.int64))
            owners.append(owner[1:][at])
            same = same[: len(same) - 1] & again[times - 1 :]
    if not parts:
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(n + 1))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text, of whole texts."""
    data, offsets = W.text_bytes(column)
    last = np.full(DIMENSIONS, -1, np.int64)
    for i, j in W.slices(offsets):
        raw, at = _raw_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            own = raw[at[k] : at[k + 1]]
            place = np.arange(len(own))
            last[own] = place
            yield own[last[own] == place]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = []
    for label in (1, 0):
        c = np.full(DIMENSIONS, SMOOTH)
        for r, v in zip(rows, y):
            if v == label:
                c[r] += 1  # a row names a feature once
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights over the plain indicators (the ratio is multiplied in), and the bias last.

    Dual coordinate descent for the hinge loss: one dual variable per row, each step solves
    for its variable exactly. Rows are scaled to unit length.
    """
    ratio = log_count_ratio(rows, y)
    scale = [1 / max(1e-12, np.sqrt(ratio[r] @ ratio[r])) for r in rows]
    weights, bias = np.zeros(DIMENSIONS), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    # Both classes get the same total penalty.
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    cost *= PENALTY * len(rows) * 10
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] * scale[i]
            gradient = sign[i] * (weights[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[r] += step * v
                bias += step
                alpha[i] = new
    return np.append(weights * ratio, bias)


def margins(model: np.ndarray, rows, ratio: np.ndarray) -> np.ndarray:
    out = []
    for r in rows:
        v = ratio[r]
        out.append(model[r].sum() / max(1e-12, np.sqrt(v @ v)) + model[-1])
    return np.array(out)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps; targets kept off 0 and 1."""
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-6 * a, (p - t).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """The model: weights, ratio, curve. With one class only, a constant score."""
    if len(y) == 0 or y.min() == y.max():
        return {"constant": 0.5 if len(y) == 0 else float(y[0])}
    fold = np.random.default_rng(1).permutation(len(y)) % FOLDS
    out = np.zeros(len(y))
    whole = all(0 < y[fold != f].sum() < (fold != f).sum() for f in range(FOLDS))
    for f in range(FOLDS) if whole else ():
        train = [rows[i] for i in np.flatnonzero(fold != f)]
        ratio = log_count_ratio(train, y[fold != f])
        model = fit_hinge(train, y[fold != f])
        out[fold == f] = margins(model, [rows[i] for i in np.flatnonzero(fold == f)], ratio)
    ratio, model = log_count_ratio(rows, y), fit_hinge(rows, y)
    if not whole:
        out = margins(model, rows, ratio)
    return {"weights": model, "ratio": ratio, "curve": fit_curve(out, y)}


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAIN_ROWS,
    max_bytes: int = MAX_TRAIN_BYTES,
) -> dict:
    """Fit on at most ``max_rows`` labelled documents outside the held-out part, those with the
    smallest hash of their id, and of them on the first whose features have ``max_bytes``.

    A document labelled twice counts once, as the lower quality; one that stands there many
    times counts once, with the least of its texts.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"))
        .orderBy(order, "doc_id")
        .limit(max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            rows = [r.astype(np.int32).tobytes() for r in features(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())],
                ["doc_id", "y", "features"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        made = scratch.save(
            sample.mapInArrow(run, f"doc_id {kind}, y int, features binary").withColumn("_h", order),
            "quality-sample",
        )
        sizes = made.select("_h", F.octet_length("features").alias("n")).toArrow()
        within = np.argsort(sizes["_h"].to_numpy(), kind="stable")
        through = np.cumsum(sizes["n"].to_numpy()[within].astype(np.int64))
        count = int(np.searchsorted(through, max_bytes, side="right"))
        if count < len(within):
            made = made.where(F.col("_h") < int(sizes["_h"][int(within[count])].as_py()))
        got = made.drop("_h").toArrow()
    # Views into one buffer: the sample is held once.
    data, at = W.text_bytes(got["features"])
    rows = [data[i:j].view(np.int32) for i, j in zip(at[:-1], at[1:])]
    ids = got["doc_id"].to_pylist()
    ranks = sorted(range(len(rows)), key=ids.__getitem__)  # each id stands there once
    y = got["y"].to_numpy()
    return fit([rows[i] for i in ranks], np.array([y[i] for i in ranks], np.int64))


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, held_out, score, predicted`` per row of ``docs(doc_id, text)``.

    Only the text decides the score. Null and empty texts have no features and get the score
    of the bias alone. Labels that are null or not 0 or 1 are not learned from; without
    labels of both classes the score is constant (0.5 without any). Repeated rows get the
    same score and are learned from once. Texts are read whole, whatever their length. A null
    doc_id counts as an empty one for the held-out part.
    """
    spark = docs.sparkSession
    model = train(docs, labels)
    # Fixed size, whatever the corpus: DIMENSIONS weights and ratios.
    shared = spark.sparkContext.broadcast(model)
    names = list(keep)
    frame = docs.select(*keep, "text")

    def run(batches):
        model = shared.value
        if "constant" not in model:
            weights, ratio2, (a, b) = model["weights"], model["ratio"] ** 2, model["curve"]
        for batch in batches:
            text = batch.column(len(names))
            if "constant" in model:
                p = np.full(batch.num_rows, model["constant"])
            else:
                x = np.array(
                    [weights[r].sum() / max(1e-12, ratio2[r].sum()) ** 0.5 for r in features(text)]
                ) + weights[-1]
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(p, pa.float64())],
                [*names, "score"],
            )

    scored = frame.mapInArrow(run, with_columns(docs, keep, "score double"))
    return scored.select(
        *names,
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
