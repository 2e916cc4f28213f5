"""Whitening of embeddings by shifted CholeskyQR.

The rows that are fitted are the distinct vectors on a grid of 1/256, centred. A pass over
them sums the Gram matrix of the rows times the inverse of the R found so far; its Cholesky
factor (with a shift in the first pass, so that it exists however close the dimensions are to
dependent) is multiplied into R. After two or three passes the rows times R^-1 are orthonormal
to double precision, so the singular values and right vectors of R are those of the rows.
Unlike those of a Gram matrix they come without squaring the condition number. Tasks return
sums, one small matrix each, which Spark adds up entry by entry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch, with_columns

SCALE = 256
TOP = 4  # components returned
PASSES = 6  # at most; two or three are usual
TOLERANCE = 1e-13  # largest departure of the Gram matrix from a projection, per dimension
ROWS = 4096  # rows per block of a task
LONG = 2**63 - 1


def grid(column: str = "embedding") -> str:
    """SQL: entries as whole multiples of 1/256; null for an unusable vector."""
    usable = f"""{column} IS NOT NULL AND forall({column}, c -> c IS NOT NULL
        AND NOT isnan(c) AND abs(cast(c AS double)) < double('Infinity'))"""
    return f"IF({usable}, transform({column}, c -> floor(cast(c AS double) * {SCALE})), NULL)"


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Per batch and width: the batch, the numbers of its rows of that width, and their entries."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            cells = part.column(column)
            width = np.asarray(cells.value_lengths().fill_null(0))
            for d in np.unique(width[width > 0]):
                rows = np.flatnonzero(width == d)
                flat = cells.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                yield part, rows, flat.reshape(len(rows), d)


def _sums(
    fit: DataFrame, widths: list[int], partial: Callable[[int, np.ndarray], np.ndarray]
) -> dict[int, np.ndarray]:
    """Per width: the sum of ``partial`` over all blocks of rows. A task adds up its own
    blocks and returns the entries once; entries are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, _, x in _blocks(batches, 0):
            d = x.shape[1]
            own = partial(d, x)
            total[d] = total[d] + own if d in total else own
        for d, t in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t[i, j])],
                ["d", "i", "j", "v"],
            )

    entries = fit.select("x").mapInArrow(run, "d int, i int, j int, v double")
    got = entries.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    d, i, j, v = (np.asarray(got[c]) for c in ("d", "i", "j", "v"))
    out = {}
    for w in widths:
        own = d == w
        m = np.zeros((w, w))
        m[i[own], j[own]] = v[own]
        out[w] = m + np.triu(m, 1).T
    return out


def _totals(fit: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """Per width: the number of rows, the exact sum of every dimension, the largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        most: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for _, _, x in _blocks(batches, 0):
            d = x.shape[1]
            big = max(abs(int(x.min())), abs(int(x.max())))
            # A whole-number sum that cannot overflow, or Python's.
            s = (x if big * len(x) < 2**62 else x.astype(object)).sum(0).tolist()
            n[d] = n.get(d, 0) + len(x)
            most[d] = max(most.get(d, 0), big)
            total[d] = [a + b for a, b in zip(total[d], s)] if d in total else s
        for d in n:
            yield pa.RecordBatch.from_pydict(
                {"d": [d] * d, "j": list(range(d)), "n": [n[d]] * d, "s": [str(v) for v in total[d]], "m": [str(most[d])] * d},
                schema=pa.schema([("d", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("s", pa.string()), ("m", pa.string())]),
            )

    parts = fit.select("x").mapInArrow(run, "d int, j int, n long, s string, m string")
    exact = "cast({} AS decimal(38, 0))"
    got = (
        parts.groupBy("d", "j")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.expr(exact.format("s"))).alias("s"),
            F.max(F.expr(exact.format("m"))).alias("m"),
        )
        .orderBy("d", "j")
        .collect()
    )
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in got:
        n, s, m = out.setdefault(r.d, (r.n, [], int(r.m)))
        s.append(int(r.s))
    return out


def _solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inv(r)`` for an upper triangle, column by column."""
    q = np.empty_like(rows)
    for j in range(r.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


@dataclass
class Space:
    """What is known of the vectors of one width."""

    n: int
    total: list[int]
    largest: int
    mean: np.ndarray
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # columns
    passes: int
    orthogonality: float


def _centred(mean: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def fit_spaces(fit: DataFrame) -> dict[int, Space]:
    """A space per width of the distinct vectors ``fit(x)``."""
    totals = _totals(fit)
    means = {d: np.array([s / n for s in t]) for d, (n, t, _) in totals.items()}
    widths = list(totals)
    r: dict[int, list[np.ndarray]] = {d: [] for d in widths}
    last = dict.fromkeys(widths)
    done: dict[int, int] = {}
    for k in range(PASSES):
        todo = [d for d in widths if d not in done]
        if not todo:
            break
        factors = {d: list(r[d]) for d in todo}

        def gram(d: int, x: np.ndarray, factors=factors) -> np.ndarray:
            if d not in factors:
                return np.zeros((d, d))
            q = _centred(means[d], x)
            for factor in factors[d]:
                q = _solve(q, factor)
            return q.T @ q

        for d, g in _sums(fit, todo, gram).items():
            n = totals[d][0]
            last[d] = g
            if k:
                # Orthonormal, but for directions without variance, where it is 0.
                values = np.linalg.eigvalsh(g)
                off = np.abs(values - np.round(values)).max()
                if off <= TOLERANCE * d and np.abs(np.round(values)).max() <= 1:
                    done[d] = k + 1
                    continue
            size = max(float(np.trace(g)), 1e-200)
            unit = np.finfo(float).eps / 2 * size
            shift = 0.0 if k else 11 * (n * d + d * (d + 1)) * unit
            while True:
                try:
                    r[d].append(np.linalg.cholesky(g + shift * np.eye(d)).T)
                    break
                except np.linalg.LinAlgError:  # without variance in some direction
                    shift = max(10 * shift, unit)
    out = {}
    for d in widths:
        n, total, largest = totals[d]
        # What the last pass still found is the rest of the factor.
        w, u = np.linalg.eigh(last[d])
        root = (u * np.sqrt(np.maximum(w, 0))) @ u.T
        whole = root
        for factor in reversed(r[d]):
            whole = whole @ factor
        _, s, vt = np.linalg.svd(whole)
        values = s**2 / n
        floor = (s[0] * math.sqrt(n * d) * np.finfo(float).eps) ** 2 / n if d else 0.0
        keep = values > floor
        v = vt[keep].T
        # One sign for reruns: the largest entry of a component is positive.
        v = v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1.0, 1.0)
        off = np.linalg.eigvalsh(last[d])
        out[d] = Space(
            n, total, largest, means[d], values[keep], v, done.get(d, PASSES),
            float(np.abs(off - np.round(off)).max()),
        )
    return out


def _deviation(x: np.ndarray, space: Space) -> list[int | None]:
    """The exact sum of (n*x - S)^2 per row; null where it is beyond a long."""
    s = max(map(abs, space.total))
    bound = x.shape[1] * (space.n * space.largest + s) ** 2
    kind = np.int64 if bound <= LONG else object
    diff = x.astype(kind) * space.n - np.array(space.total, dtype=kind)
    return [int(v) if v <= LONG else None for v in (diff * diff).sum(1)]


def whiten(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row of
    ``vectors(vec_id, embedding, ..)`` and each of its first ``top`` components.

    A vector that is null or holds a null or non-finite entry is left out. An entry c counts as
    the whole number floor(256 * c), at the ends of a long if it is beyond them. Equal vectors
    are fitted once, however many rows hold them, but every row is returned. Vectors of
    different widths are spaces of their own, with components of their own; an empty vector
    has none and no row. Components without variance are left out, so a space of one distinct
    vector has no rows, and one of two has one component. An empty table gives an empty
    result. Columns beside ``vec_id`` and ``embedding`` are not read; rows that repeat a vec_id
    are returned each.
    """
    spark = vectors.sparkSession
    usable = vectors.select("vec_id", F.expr(grid()).alias("x")).where("size(x) > 0")
    schema = with_columns(
        vectors, ["vec_id"],
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    )
    with Scratch(spark) as scratch:
        fit = scratch.save(usable.select("x").distinct(), "whitening-fit")
        spaces = fit_spaces(fit)
        maps = {d: (s.mean, s.vectors[:, :top] / np.sqrt(s.values[:top])) for d, s in spaces.items()}

        def squared(d: int, x: np.ndarray) -> np.ndarray:
            mean, to = maps[d]
            out = np.zeros((d, d))
            y = _centred(mean, x) @ to
            k = to.shape[1]
            out[:k, :k] = y.T @ y
            return out

        errors = {}
        for d, g in _sums(fit, list(spaces), squared).items():
            k = maps[d][1].shape[1]
            errors[d] = float(np.abs(g[:k, :k] / spaces[d].n - np.eye(k)).max()) if k else 0.0
    explained = {d: s.values[:top] / s.values.sum() for d, s in spaces.items() if len(s.values)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _blocks(batches, 1):
            d = x.shape[1]
            mean, to = maps[d]
            k = to.shape[1]
            if not k:
                continue
            y = _centred(mean, x) @ to
            m = len(rows)
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, spaces[d].n, np.int64)),
                    pa.array(_deviation(x, spaces[d]), pa.int64()).take(pa.array(again)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained[d], m)),
                    pa.array(np.full(m * k, errors[d])),
                ],
                schema.names,
            )

    return usable.mapInArrow(run, schema)
