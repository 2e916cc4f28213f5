"""Near-duplicate embeddings: small-world graphs per shard, every shard asked for every vector.

Vectors are dealt out to shards by hash, and each shard is a graph index over its vectors. An
audit widens the shard's beam until queries at the link threshold are found again. A task
holds two shards and looks the vectors of each up in the other, so a link is known to both ends
whichever of them found it. A beam that comes back full of neighbours is widened for that
vector. Candidates are verified by cosine in double precision. Links are counted
where they are found, and only a spanning forest of them leaves a task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch, bucket_count, save
from gradeloom.llm.components import components
from gradeloom.llm.hnsw import build, dump, load

LINK = 0.95
SHARDS = 8  # at least; more as soon as one would have more vectors or bytes than these
SHARD_ROWS, SHARD_BYTES = 32_768, 64 << 20
BLOCK = 512  # queries at once
WIDER = 2  # doublings of a beam before it is the whole shard
BEAM, WANTED_RECALL, AUDIT = 48, 0.98, 256  # audit queries per shard
SLACK = 1e-4  # candidates are taken this far below the threshold, then verified


def _classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, dim, vector`` per row; all but vec_id null where a vector is not usable."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raw = [], [], []
            for x in batch.column(1):
                v = None
                if x.is_valid and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore"):
                        if not len(v) or not np.isfinite(v).all() or not v.any():
                            v = None
                if v is not None:
                    v = v / np.abs(v).max()  # cosine does not change, squares do not overflow
                b = None if v is None else v.tobytes()
                raw.append(b)
                dims.append(None if v is None else len(v))
                keys.append(None if b is None else hashlib.blake2b(b, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                ["vec_id", "key", "dim", "vector"],
            )

    return vectors.select("vec_id", "embedding").mapInArrow(
        run, f"vec_id {kind}, key binary, dim int, vector binary"
    )


def _unit(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    exact = np.stack([np.frombuffer(b, np.float64) for b in raw])
    exact = exact / np.sqrt((exact**2).sum(1))[:, None]
    return exact, exact.astype(np.float32)


def audit(index, unit: np.ndarray, link: float, seed: int = 0) -> int:
    """The beam at which sampled vectors, turned away to the threshold, find themselves."""
    rng = np.random.default_rng(seed)
    n, d = unit.shape
    chosen = rng.permutation(n)[:AUDIT]
    noise = rng.standard_normal((len(chosen), d))
    noise -= (noise * unit[chosen]).sum(1)[:, None] * unit[chosen]
    size = np.sqrt((noise**2).sum(1))[:, None]
    away = link * unit[chosen] + np.sqrt(1 - link**2) * noise / np.maximum(size, 1e-30)
    beam = BEAM
    while beam < n:
        ids, sims = index.search(away.astype(np.float32), beam)
        # Itself, or as many others that are nearer.
        found = (ids == chosen[:, None]).any(1) | (sims[:, -1] > link)
        if found.mean() >= WANTED_RECALL:
            break
        beam *= 2
    return beam


def _build(link: float):
    def run(table: pa.Table) -> pa.Table:
        exact, unit = _unit(table["vector"].to_pylist())
        index = build(unit)
        packed = pickle.dumps(
            (dump(index), exact, np.array(table["size"].to_pylist()), table["key"].to_pylist(), audit(index, unit, link))
        )
        return pa.table({
            "dim": table["dim"][:1].combine_chunks(), "shard": table["shard"][:1].combine_chunks(),
            "index": pa.array([packed], pa.binary()),
        })

    return run


def neighbours(index, exact: np.ndarray, queries: np.ndarray, beam: int, link: float) -> np.ndarray:
    """Per query a row of flags: the nodes found to be linked with it."""
    n = len(exact)
    out = np.zeros((len(queries), n), bool)
    todo, asked = np.arange(len(queries)), queries.astype(np.float32)
    for step in range(WIDER + 2):
        ids, sims = index.search(asked[todo], beam if step <= WIDER else n)
        full = (sims[:, -1] >= link - 0.05) & (ids.shape[1] < n)
        r, c = np.nonzero((sims >= link - SLACK) & (ids >= 0) & ~full[:, None])
        q, v = todo[r], ids[r, c]
        for s in range(0, len(q), 1 << 16):
            x, y = q[s : s + (1 << 16)], v[s : s + (1 << 16)]
            ok = np.einsum("ij,ij->i", queries[x], exact[y]) >= link
            out[x[ok], y[ok]] = True
        todo, beam = todo[full], 2 * beam
        if not len(todo):
            break
    return out


def links_between(a, b, link: float) -> np.ndarray:
    """One bit per vector of ``a`` (rows) and of ``b`` (columns): linked, as found from either
    side. Each is ``index, exact, beam``; ``b`` is None for the links within ``a``."""
    (index_a, exact_a, beam_a), (index_b, exact_b, beam_b) = a, b or a
    bits = np.zeros((len(exact_a), (len(exact_b) + 7) // 8), np.uint8)
    for i in range(0, len(exact_a), BLOCK):
        found = neighbours(index_b, exact_b, exact_a[i : i + BLOCK], beam_b, link)
        if b is None:
            found[np.arange(len(found)), i + np.arange(len(found))] = False
        bits[i : i + BLOCK] |= np.packbits(found, axis=1)
        if b is None:
            bits[:, i // 8 : (i + BLOCK) // 8] |= np.packbits(found.T, axis=1)
    for i in range(0, len(exact_b) if b else 0, BLOCK):
        found = neighbours(index_a, exact_a, exact_b[i : i + BLOCK], beam_a, link)
        bits[:, i // 8 : (i + BLOCK) // 8] |= np.packbits(found.T, axis=1)
    return bits


def _forest(linked: Iterator[tuple[int, np.ndarray]], nodes: int) -> Iterator[tuple[int, int]]:
    """Edges that join what the rows ``node, its neighbours`` join, fewer than ``nodes``."""
    above = np.arange(nodes)

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = int(above[x])
        return x

    for node, near in linked:
        top = root(node)
        for other in np.unique(above[near]).tolist():
            other = root(other)
            if other != top:
                yield top, other
                above[other] = top
        above[near] = top  # a dense group costs a few array operations a row


def _ask(link: float):
    def run(both: pa.Table) -> pa.Table:
        nothing = pa.table({"u": pa.array([], pa.binary()), "v": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        if both.num_rows == 1 and both["shard"][0] != both["other"][0]:
            return nothing  # the other shard holds no vector
        shards = []
        for cell in both.sort_by("shard")["index"]:
            layers, exact, size, names, beam = pickle.loads(cell.as_py())
            shards.append((load(exact.astype(np.float32), layers), exact, beam, size, names))
        low, high = shards[0], shards[-1]
        one = len(shards) == 1
        bits = links_between(low[:3], None if one else high[:3], link)
        first, second = len(low[4]), len(high[4])
        here, there = np.zeros(first, np.int64), np.zeros(second, np.int64)

        def rows() -> Iterator[tuple[int, np.ndarray]]:
            for i in np.flatnonzero(bits.any(axis=1)).tolist():
                near = np.flatnonzero(np.unpackbits(bits[i], count=second))
                here[i] = high[3][near].sum()
                there[near] += low[3][i]
                yield i, near if one else first + near

        names = low[4] if one else low[4] + high[4]
        edges = list(_forest(rows(), len(names)))
        degree = here if one else np.concatenate([here, there])
        some = np.flatnonzero(degree).tolist()
        u = [names[i] for i in some] + [names[x] for x, _ in edges]
        v = [None] * len(some) + [names[y] for _, y in edges]
        count = degree[some].tolist() + [0] * len(edges)
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "n": pa.array(count, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, link: float = LINK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold a null or a number that is not finite link
    with nothing. Vectors of different length never link. Equal vectors are one class, linked
    among themselves, and looked up once. A null vec_id takes part but is never the
    smallest unless all of a component are null. Other columns are not read.
    """
    rows, known = _joined(vectors, link)
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _joined(vectors: DataFrame, link: float) -> tuple[DataFrame, DataFrame]:
    """``vec_id, key`` of every row, and ``key, component_id, n_links`` of every class."""
    with Scratch(vectors.sparkSession) as scratch:
        every = scratch.save(_classes(vectors), "emb-every")
        rows = save(every.select("vec_id", "key"), "emb-rows")
        classes = scratch.save(
            every.where("key IS NOT NULL").groupBy("key").agg(
                F.min("vec_id").alias("vec_id"), F.count("*").alias("size"),
                F.first("dim").alias("dim"), F.first("vector").alias("vector"),
            ),
            "emb-classes",
        )
        n, size = classes.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("dim")), F.lit(0))).first()
        shards = max(SHARDS, bucket_count(n, SHARD_ROWS), bucket_count(size, SHARD_BYTES))
        indexes = scratch.save(
            classes.select("dim", F.expr(f"int(pmod(xxhash64(key), {shards}))").alias("shard"), "key", "size", "vector")
            .groupBy("dim", "shard").applyInArrow(_build(link), "dim int, shard int, index binary"),
            "emb-index",
        )
        # Every pair of shards meets once, a shard with itself too.
        other = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("other")
        found = scratch.save(
            indexes.select("dim", "shard", "index", other)
            .groupBy("dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"))
            .applyInArrow(_ask(link), "u binary, v binary, n bigint"),
            "emb-found",
        )
        degree = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
        joined = components(found.where("v IS NOT NULL").select("u", "v"), scratch, "emb-joined")
        rooted = classes.join(joined, classes["key"] == joined["node"], "left").select(
            "key", "vec_id", "size", F.coalesce("root", "key").alias("root")
        )
        rooted = scratch.save(rooted, "emb-rooted")
        # Written first, so that a large component is a plain join key, which Spark splits.
        smallest = scratch.save(
            rooted.groupBy("root").agg(F.min("vec_id").alias("component_id")), "emb-smallest"
        )
        known = rooted.join(smallest, "root").join(degree, rooted["key"] == degree["u"], "left")
        known = save(
            known.select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")),
            "emb-known",
        )
        return rows, known
