"""Near-duplicates, repeats, leaks, quality and language model on awkward small tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import llm_brute as brute
from gradeloom.llm import decontaminate, lm, minhash, quality, repeats
from gradeloom.llm.components import components
from gradeloom.llm.common import Scratch
from gradeloom.llm.lyndon import suffix_array

# Columns that bear the names of the operators' own.
EXTRA = "key string, row bigint, n bigint, place string, hits string, score string, root int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, shared passages, periodic and very long texts, empty and null
    texts, null and repeated ids, repeated rows."""
    rng = random.Random(seed)
    base, rows = words(rng, 160), []
    passage = " ".join(words(rng, 60))
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, f"{' '.join(words(rng, 40))} {passage} {' '.join(words(rng, 30))}") for i in range(12)]
    rows += [(200, "ab" * 3000), (201, "ab" * 900), (202, "Éé " * 800), (203, "x" * 9000), (204, "x" * 99)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "ONE"), (305, "two words"), (306, None)]
    rows += [(None, rows[3][1]), (None, "a lone text of some seven words"), (None, None)]
    rows += [rows[5], rows[5], (7, rows[61][1]), rows[65]]
    rows.append((400, " ".join(words(rng, 30_000, 5000))))
    return rows


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, *[None] * 7) for d, t in rows], f"doc_id bigint, text string, {EXTRA}")
    return df.repartition(parts)


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_near_duplicates(spark, rows):
    got = found(minhash.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(rows), key=repr)


def test_large_block_meets_in_tiles(spark, rows, monkeypatch):
    whole = minhash._tiles
    monkeypatch.setattr(minhash, "_tiles", lambda m, s: whole(m, s, tile=8))
    got = found(minhash.near_duplicates(frame(spark, rows)), "doc_id", "component_id")
    assert got == sorted(((d, c) for d, _, c, _ in brute.near(rows)), key=repr)


def test_deduplicate_keeps_one_of_each(spark, rows):
    df = frame(spark, rows)
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    want, roots = brute.near_and_roots(rows)
    assert kept.count() == len(set(roots))
    best = {r: w[2] for w, r in zip(want, roots)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(best.values(), key=repr)


def test_pipeline_takes_near_copies_from_80_percent_on(spark):
    """Pairs planted on both sides of 0.80, and between it and 0.85."""
    rng, docs = random.Random(9), []
    for i in range(120):
        own = words(rng, 104, 10**6)
        docs.append((2 * i, " ".join(own)))
        # Each changed word far from the others takes five of the 100 shingles.
        for k in range(1 + i % 4):
            own[10 + 20 * k] = "changed"
        docs.append((2 * i + 1, " ".join(own[: len(own) - i % 3])))
    docs = [(d, t, "s") for d, t in docs]
    pairs = list(map(tuple, zip(*[iter(docs)] * 2)))
    share = [
        len(a & b) / len(a | b)
        for a, b in ((brute.shingles(x[1]), brute.shingles(y[1])) for x, y in pairs)
    ]
    assert sum(0.8 <= x < 0.85 for x in share) >= 20 and min(share) < 0.8
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect()
    want = {c for _, _, c, _ in brute.near([d[:2] for d in docs], 80)}
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_bands_find_pairs_at_the_threshold():
    for percent in (5, 50, 80, 85, 100):
        bands, each = minhash.banding(percent)
        assert (1 - (percent / 100) ** each) ** bands <= 1e-6
    assert minhash.banding(85) == (32, 6)


def test_repeats(spark, rows):
    got = found(
        repeats.repeats(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
    assert got == sorted(brute.repeats(rows), key=repr)


def test_repeats_of_a_hot_hash(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_PIECES", 3)
    got = found(repeats.repeats(frame(spark, rows)), "doc_id", "n_removed", "kept_sha256")
    assert got == sorted(((d, r, h) for d, _, r, _, h in brute.repeats(rows)), key=repr)


def test_removed_text_fits_its_digest(spark, rows):
    import hashlib

    df = frame(spark, rows)
    cut = repeats.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    ascii_ = [(d, t) for d, t in rows if d != 202]
    want = sorted(((d, h) for d, _, _, _, h in brute.repeats(ascii_)), key=repr)
    got = [
        (d, hashlib.sha256((t or "").encode()).hexdigest())
        for d, t in found(repeats.remove_repeats(frame(spark, ascii_)), "doc_id", "text")
    ]
    assert sorted(got, key=repr) == want


def test_leaks(spark, rows):
    rng = random.Random(5)
    texts = [t.split() for _, t in rows if t and len(t) < 9000 and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(texts)[5:30])) for i in range(8)]
    items += [(8, "Two, WORDS!"), (9, "one"), (10, None), (11, ""), (12, "..."), (3, "lone text"), (None, "some seven")]
    items.append(items[0])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = found(
        decontaminate.find(frame(spark, rows), bench),
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
    )
    assert got == sorted(brute.leaks(rows, items), key=repr)


def test_suffix_array_is_sorted():
    rng = random.Random(0)
    for _ in range(300):
        t = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(50))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, 4)]
    with Scratch(spark) as scratch:
        out = components(spark.createDataFrame(edges, "u bigint, v bigint"), scratch)
        got = {r["node"]: r["root"] for r in out.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.1


def labelled(seed=2, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        own = words(rng, 60)
        docs.append((i, " ".join(own if good else [w.upper() + "!!" for w in own])))
        labels.append((i, int(good)))
    return docs, labels


def test_quality_separates_and_holds_out(spark):
    docs, labels = labelled()
    labels += [(None, 1), (3, None), (4, 7), (5, 1 - labels[5][1])]
    docs += [(900, None), (901, ""), (None, "w1 w2"), docs[0]]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.score(frame(spark, docs), known).collect()
    assert len(got) == len(docs)
    import zlib

    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    right = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["held_out"] and (r["doc_id"] or 999) < 400]
    assert len(right) > 40 and np.mean(right) > 0.97


def test_quality_without_labels_of_both_classes(spark):
    docs, labels = labelled(n=20)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(frame(spark, docs), none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(frame(spark, docs), ones).collect()} == {1.0}


def test_network_gradient():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm.start_parameters().items()}
    ids = rng.integers(0, lm.WORDS, 50)
    around = lm.contexts(ids, np.array([0, 20, 20, 50]))
    _, grad = lm.forward(p, around, ids, learn=True)
    for name in p:
        flat, g = p[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.permutation(np.flatnonzero(g))[:3]:
            h, old = 1e-5, flat[i]
            flat[i] = old + h
            up = lm.forward(p, around, ids).mean()
            flat[i] = old - h
            down = lm.forward(p, around, ids).mean()
            flat[i] = old
            assert abs(-(up - down) / (2 * h) - g[i]) < 1e-6


def test_only_embeddings_with_a_gradient_are_stepped():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, lm.WORDS, 300)
    around = lm.contexts(ids, np.array([0, 200, 200, 300]))
    p = lm.start_parameters()
    _, grad, rows = lm._passed(p, around, ids, True)
    _, dense = lm.forward(p, around, ids, learn=True)
    for k, (own, g) in enumerate(rows):
        assert own.tolist() == sorted(set(around[k].tolist())) and len(own) < len(dense["embed"][k]) / 3
        assert (dense["embed"][k][own] == g).all()
    stepped = {k: v.copy() for k, v in p.items()}
    assert lm.learn(stepped, iter([(around, ids)])) == len(ids)
    for k, g in dense.items():
        had = np.full_like(g, 1e-6) + g * g
        assert (stepped[k] == p[k] - lm.RATE * g / np.sqrt(had)).all()


def test_contexts_stay_inside_texts():
    around = lm.contexts(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]))
    e = lm.EDGE
    assert around.tolist() == [[e, e, 1, e], [e, 1, 2, e], [2, 3, e, e], [3, e, e, e]]


def test_lm_scores_all_words(spark, rows):
    df = frame(spark, rows)
    got = lm.score(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"] == 0) == (r["mean_log_prob"] is None) and r["log_prob"] <= 0
    want = sorted((d, len((t or "").split())) for d, t in rows if d is not None and d != 202)
    assert sorted((r["doc_id"], r["n_words"]) for r in got if r["doc_id"] not in (None, 202)) == want


def test_lm_learns_what_stands_around(spark):
    """A word that its neighbours determine becomes likelier than its frequency."""
    rng = random.Random(3)
    docs = []
    for i in range(1200):
        w = []
        for _ in range(60):
            k = rng.randrange(20)
            w += [f"a{k}", f"b{k}", f"c{k}"]
        docs.append((i, " ".join(w)))
    scored = lm.score(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2))
    mean = np.mean([r["mean_log_prob"] for r in scored.collect()])
    assert mean > -np.log(60) * 0.85


def test_lm_scores_do_not_depend_on_the_layout(spark, rows, monkeypatch):
    monkeypatch.setattr(lm, "PART_WORDS", 500)
    monkeypatch.setattr(lm, "PER_PARAMETER", 0)
    monkeypatch.setattr(lm, "GATHER", 200)
    df, got = frame(spark, rows), []
    for n in (2, 16, 211):
        scored = lm.score(df.repartition(n), keep=("doc_id", "text")).collect()
        got.append(sorted(((repr(r["doc_id"]), repr(r["text"]), r["log_prob"]) for r in scored)))
    for other in got[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in got[0]]
        assert np.allclose([r[2] for r in other], [r[2] for r in got[0]], rtol=1e-5, atol=1e-4)


def test_lm_broadcasts_plain_arrays():
    import pickle

    words = lm.Vocabulary([5, -3], np.array([4, 0]), 2)
    state = pickle.dumps(vars(words))
    assert b"gradeloom" not in state
    h = np.array([5, 2**64 - 3, 8, 9], np.uint64)
    assert lm.Vocabulary.of(pickle.loads(state)).ids(h).tolist() == words.ids(h).tolist()


def test_lm_tells_rare_words_apart(spark):
    """Words without a number of their own are scored by their own counts: of two in one place
    and between the same neighbours, the ratio of probabilities is that of the counts."""
    from gradeloom.llm import wordhash as W

    many = [f"w{i}" for i in range(3000)]
    rare = [f"r{i}" for i in range(400)]
    data, offsets = W.text_bytes(pa.array(rare))
    places = W.word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(64)
    two = next((a, b) for b in range(400) for a in range(b) if places[a] == places[b])
    a, b = rare[two[0]], rare[two[1]]
    docs = [(0, f"w1 w2 {a} w3 w4"), (1, f"w1 w2 {b} w3 w4"), (1, f"w1 w2 {b} w3 w4"), (2, f"{b} {b}")]
    docs += [(10 + k, " ".join(many)) for k in range(9)]
    got = {r["doc_id"]: r["log_prob"] for r in lm.score(frame(spark, docs)).collect()}
    assert got[1] - got[0] == pytest.approx(np.log(4), abs=1e-6)


def test_lm_network_grows_with_the_distinct_words(spark):
    docs = [(i, " ".join(f"w{j}" for j in range(i * 5000, i * 5000 + 5000))) for i in range(80)]
    counts = lm.word_counts(frame(spark, docs, 8))
    words = lm.vocabulary(counts)
    assert words.classes > lm.vocabulary(counts.limit(1000)).classes
    assert len(words.sorted) + len(words.place_logs) == words.classes**2


@pytest.mark.parametrize("run", [
    lambda d, s: minhash.near_duplicates(d), lambda d, s: minhash.deduplicate(d),
    lambda d, s: repeats.repeats(d), lambda d, s: repeats.remove_repeats(d), lambda d, s: lm.score(d),
    lambda d, s: decontaminate.find(d, s.createDataFrame([], "item_id bigint, text string")),
    lambda d, s: quality.score(d, s.createDataFrame([], "doc_id bigint, quality int")),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, []), spark).collect() == []
