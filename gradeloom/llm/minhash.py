"""Near-duplicate documents by MinHash.

Signatures are minima of many universal hashes over a text's five-word shingles. Bands of the
signature put texts into buckets; texts chained by common buckets form a block. Inside
blocks, pairs whose signatures agree enough are confirmed on their full shingle sets, and the
confirmed links are closed to components by large-star and small-star rounds. Documents with
equal sets are one class from the start, so copies are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as W
from gradeloom.llm.common import (
    Scratch, bitmap, bucket_count, in_bitmap, save, split,
)
from gradeloom.llm.components import components

SHINGLE = 5
LINK_PERCENT = 85
MINIMA, MISS = 192, 1e-6  # about so many minima; a pair at the threshold misses all buckets so rarely
TILE = 256  # texts of a large block that are held in memory at once, twice


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the longest bands that still find the pairs at the threshold. 32 of 6
    for 85 (3e-7), 39 of 5 for 80 (2e-7)."""
    t = percent / 100
    for rows in range(8, 0, -1):
        bands = -(-MINIMA // rows)
        if (1 - t**rows) ** bands <= MISS:
            return bands, rows
    return math.ceil(math.log(MISS) / math.log(1 - t)), 1


@cache
def _hashes(minima: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, minima, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, minima, np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of texts: the sorted distinct shingle hashes, text by text, and offsets."""
    data, offsets = W.text_bytes(column)
    for i, j in W.slices(offsets):
        own = W.lower_ascii(data[offsets[i] : offsets[j]])
        starts, ends, first = W.word_spans(own, offsets[i : j + 1] - offsets[i], W.NOT_SPACE)
        words = W.word_hashes(own, starts, ends) if len(starts) else np.empty(0, np.uint64)
        grams = W.gram_hashes(words, SHINGLE)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                h = np.sort(grams[a : b - SHINGLE + 1])
                sets.append(h[np.append(True, h[1:] != h[:-1])])
            else:
                sets.append(W.gram_hashes(words[a:b], b - a) if b > a else words[:0])
        at = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=at[1:])
        yield np.concatenate(sets) if sets else words, at


def set_keys(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set: sums of two mixes of its members. Empty sets have none."""
    keys = []
    for mixed in (W.mix(values), W.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed, out=total[1:])
        keys.append(W.mix(total[at[1:]] - total[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)))
    packed = np.stack(keys, 1).tobytes()
    size = np.diff(at)
    return [packed[16 * i : 16 * i + 16] if n else None for i, n in enumerate(size)]


def signatures(values: np.ndarray, at: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """``minima`` minima per non-empty set, by multiply-and-add hashes, high halves."""
    factor, shift = _hashes(minima)
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), minima), np.uint32)
    # Sets are taken in runs that fit the cache; a longer set is a run of its own.
    i = 0
    while i < len(full):
        j = i + 1
        while j < len(full) and at[full[j] + 1] - at[full[i]] <= 1 << 15:
            j += 1
        run = values[at[full[i]] : at[full[j - 1] + 1]]
        starts = at[full[i:j]] - at[full[i]]
        work = np.empty_like(run)
        for k in range(minima):
            np.multiply(run, factor[k], out=work)
            work += shift[k]
            out[i:j, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        i = j
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    h = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        h = W.mix(h * np.uint64(31) + sig[:, k::rows].astype(np.uint64))
    return h.view(np.int64)


def _scan(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, place, n, key, sig, bands`` per document, in one pass."""
    n_bands, n_rows = banding(percent)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, bands = [], [], [], []
            for values, at in shingle_sets(batch.column(2)):
                n.append(np.diff(at))
                own = set_keys(values, at)
                sig = signatures(values, at, n_bands * n_rows)
                h = iter(band_hashes(sig, n_rows))
                small = iter(sig.astype(np.uint8))
                keys += own
                for k in own:
                    sigs.append(None if k is None else next(small).tobytes())
                    bands.append(None if k is None else next(h))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.concatenate(n) if n else [], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(sigs, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "place", "n", "key", "sig", "bands"],
            )

    place = F.xxhash64("doc_id", "text").alias("place")
    return docs.select("doc_id", place, "text").mapInArrow(
        run, f"doc_id {kind}, place bigint, n bigint, key binary, sig binary, bands array<bigint>"
    )


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, members`` of the classes in ``nodes(key, place)``: the texts are read again, and
    only those whose place may be listed are cut into shingles."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(nodes, "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64)
            chosen = batch.column(1).filter(pa.array(in_bitmap(bits.value, place)))
            for values, at in shingle_sets(chosen):
                keys = set_keys(values, at)
                sets = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "members"]
                )

    place = F.xxhash64("doc_id", "text").alias("place")
    found = docs.select(place, "text").mapInArrow(run, "key binary, members binary")
    return found.where("key IS NOT NULL").groupBy("key").agg(F.first("members").alias("members"))


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def confirm(sigs: np.ndarray, sets: list[np.ndarray], parts: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs. ``parts``: if there are two kinds of parts,
    only pairs across them are looked at (the others meet elsewhere)."""
    g = len(sets)
    size = np.array([len(s) for s in sets])
    t = percent / 100
    minima = sigs.shape[1]
    least = minima * (t - 5 * np.sqrt(t * (1 - t) / minima))
    forest, out = Forest(g), []
    across = parts.min() != parts.max()
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.append(0, np.cumsum(size))
    mark = np.zeros(len(names), bool)
    for i in range(g - 1):
        later = np.arange(i + 1, g)
        ok = 100 * np.minimum(size[i], size[later]) >= percent * np.maximum(size[i], size[later])
        if across:
            ok &= parts[later] != parts[i]
        later = later[ok]
        if not len(later):
            continue
        later = later[(sigs[later] == sigs[i]).sum(1) >= least]
        root = forest.find(i)
        later = [j for j in later.tolist() if forest.find(j) != root]
        if not later:
            continue
        own = names[at[i] : at[i + 1]]
        mark[own] = True
        for j in later:
            both = int(np.count_nonzero(mark[names[at[j] : at[j + 1]]]))
            if 100 * both >= percent * (size[i] + size[j] - both) and forest.link(i, j):
                out.append((i, j))
        mark[own] = False
    return out


def _confirmed(placed: DataFrame, percent: int) -> DataFrame:
    """``u, v``: confirmed links among ``placed(tile, block, part, key, sig, members)``."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"].to_pylist()
        order = sorted(range(len(block)), key=block.__getitem__)
        keys, sigs = table["key"].to_pylist(), table["sig"].to_pylist()
        sets, parts = table["members"].to_pylist(), table["part"].to_numpy()
        u, v, i = [], [], 0
        while i < len(order):
            j = i
            while j < len(order) and block[order[j]] == block[order[i]]:
                j += 1
            own = order[i:j]
            if len(own) > 1:
                sig = np.frombuffer(b"".join(sigs[k] for k in own), np.uint8).reshape(len(own), -1)
                members = [np.frombuffer(sets[k], np.uint64) for k in own]
                for a, b in confirm(sig, members, parts[own], percent):
                    u.append(keys[own[a]])
                    v.append(keys[own[b]])
            i = j
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return placed.groupBy("tile").applyInArrow(run, "u binary, v binary")


def _tiles(members: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """Deal blocks out: small ones share a tile; a large one is cut into parts by hash, and
    every two of its parts meet in one tile."""
    sizes = scratch.save(members.groupBy("root").agg(F.count("*").alias("size")), "near-sizes")
    n = sizes.agg(F.sum("size")).first()[0] or 0
    shared = bucket_count(n, 4 * tile)
    placed = members.join(sizes, "root").withColumn("parts", F.expr(f"int(ceil(size / {tile}))"))
    part = F.expr("int(pmod(xxhash64(node, 7), parts))")
    placed = placed.withColumn("part", part)
    other = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    placed = placed.withColumn("other", F.explode(other))
    return placed.select(
        F.col("node").alias("key"),
        F.col("root").alias("block"),
        "part",
        F.expr(
            f"""IF(parts = 1, concat('s', pmod(xxhash64(root), {shared})), concat(hex(root), '/',
            least(part, other), '/', greatest(part, other)))"""
        ).alias("tile"),
    )


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, place, root`` per row of ``docs(doc_id, text)``.

    Two texts are linked if ``100 * intersection >= percent * union`` of their shingle sets.
    A text of fewer than five words is one shingle. Null, empty and blank texts have an
    empty set, no ``root``, and are components of their own. Equal texts, repeated rows among
    them, are linked; ``kept`` marks the rows with the smallest doc_id of a component, so
    a repeated row of that document is marked too. A row without doc_id takes part; it is
    never the smallest unless all are null, and is kept only then. Other columns are not
    read. ``place`` is the hash of doc_id and text, ``root`` names the component.
    """
    rows, known = _joined(docs, percent)
    result = rows.select("doc_id", "place", "key", F.col("n").alias("n_shingles")).join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "place",
        "root",
    )


def _joined(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, place, n, key`` of every row, and ``key, root, component_id`` of every set."""
    with Scratch(docs.sparkSession) as scratch:
        scan = scratch.save(_scan(docs, percent), "near-scan")
        rows = save(scan.select("doc_id", "place", "n", "key"), "near-rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "place", "sig", "bands"))
        classes = scratch.save(
            scan.where("key IS NOT NULL").groupBy("key").agg(first.alias("r"))
            .select("key", "r.doc_id", "r.place", "r.sig", "r.bands"),
            "near-classes",
        )
        banded = classes.select("key", F.explode("bands").alias("band"))
        buckets = banded.groupBy("band").agg(F.min("key").alias("pivot"), F.count("*").alias("n"))
        buckets = scratch.save(buckets.where("n > 1").drop("n"), "near-buckets")
        chained = banded.join(buckets, "band").select(F.col("key").alias("u"), F.col("pivot").alias("v"))
        blocks = components(chained, scratch, "near-blocks")
        nodes = blocks.join(classes, blocks["node"] == classes["key"]).select("key", "place", "sig")
        nodes = scratch.save(nodes, "near-nodes")
        full = scratch.save(nodes.join(_sets_of(docs, nodes), "key").drop("place"), "near-sets")
        links = _confirmed(_tiles(blocks, scratch).join(full, "key"), percent)
        joined = components(scratch.save(links, "near-links"), scratch, "near-joined")
        rooted = classes.join(joined, classes["key"] == joined["node"], "left").select(
            "key", "doc_id", F.coalesce("root", "key").alias("root")
        )
        rooted = scratch.save(rooted, "near-rooted")
        # Written first, so that a large component is a plain join key, which Spark splits.
        smallest = scratch.save(
            rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-smallest"
        )
        known = rooted.select("key", "root").join(smallest, "root")
        return rows, save(known, "near-known")


def deduplicate(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group stays: the one
    with the smallest doc_id, and one only if its row is repeated. Rows with an empty set
    all stay. Only rows that may have to go are shuffled."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", "text").alias("place"))
    found = near_duplicates(docs, percent).where("root IS NOT NULL").select("place", "root", "kept")
    found = save(found.groupBy("place", "root", "kept").agg(F.count("*").alias("n")), "near-places")
    best = found.where("kept").groupBy("root").agg(F.min("place").alias("best"))
    doubtful = found.join(best, "root").select("place", "n", (F.col("place") == F.col("best")).alias("stays"))
    doubtful = save(doubtful.where("n > 1 OR NOT stays").groupBy("place").agg(F.max("stays").alias("stays")), "near-doubtful")
    sure, possible = split(packed, doubtful, "place")
    rest = possible.join(doubtful, "place", "left").where("stays IS NULL OR stays")
    # Of rows that are repeats of one another, one stays.
    number = F.row_number().over(Window.partitionBy("place").orderBy(F.lit(0)))
    rest = rest.withColumn("_n", number).where("stays IS NULL OR _n = 1").select("_row.*")
    return sure.select("_row.*").unionByName(rest)
