"""HTML, WARC, URL rules, mixing and embeddings on awkward small tables."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest

import llm_brute as brute
from gradeloom.llm import embeddings, html, mixing, urls, warc

ARTICLE = "<article><h1>Title</h1><p>One sentence of the story, long enough.</p><p>Be.</p></article>"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("<script>var t='<p>no</p>';</script>", ""),
    (f"<nav><ul><li><a href='/x'>Menu</a></ul></nav>{ARTICLE}<footer>&copy; me</footer>",
     "Title\nOne sentence of the story, long enough.\nBe."),
    (f"<title>T</title><div class='ad'>Buy this now, it is a very good thing.</div>{ARTICLE}",
     "Title\nOne sentence of the story, long enough.\nBe."),
    (f"<main>{ARTICLE}<div id=comments><p>I like this a lot, thank you.</p></div></main>",
     "Title\nOne sentence of the story, long enough.\nBe."),
    ("<article><p>a &lt;b&gt;  &amp;\n c&#233;<br>d</p><!-- x --><form>f</form><aside>s</aside></article>", "a <b> & cé d"),
    ("<article><p>a &am<b></b>p; b &amp; c</p></article>", "a &amp; b & c"),
    ("<article><p>cut off in the <b>middle of a tag</b> <a href='", "cut off in the middle of a tag"),
    ("<article><p>a < b and 3<4</p></article>", "a < b and 3<4"),
    ("<article><p title='x>y'>quoted</p><p title=\"never closed>after</p></article>", "quoted\nafter"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
    ("<header>Site</header><article><header><h1>H</h1></header><p>Text of it.</p></article>", "H\nText of it."),
    ("<body><p>A page without an article element still has a long paragraph of text in it.</p>"
     "<div class='cookie-notice'>We use cookies, accept them.</div></body>",
     "A page without an article element still has a long paragraph of text in it."),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "<p>A paragraph of the story that is long enough to be known as one, with many words.</p>"


@pytest.mark.parametrize("page, text, kept", [
    # A short link between paragraphs, in a page that marks nothing.
    (f"<div>{LONG}<p><a href='/x'>See this</a></p>{LONG}</div>", "See this", True),
    (f"<article>{LONG}<div><a href='/x'>Here</a></div>{LONG}</article>", "Here", True),
    # A sentence within an unmarked menu.
    ("<ul><li><a href='/'>Home</a></li><li>You are here today, friend.</li><li><a href='/n'>News</a></li></ul>",
     "You are here today, friend.", False),
])
def test_cut_mends_the_classifier(page, text, kept):
    own = {t: (alone, cut) for t, alone, cut in html.labelled(page)}
    assert own[text] == (not kept, kept)
    assert (text in html.main_text(page)) == kept


def test_labels_are_the_cheapest(monkeypatch):
    rng = random.Random(7)
    tags = ["p", "li", "div", "h2", "nav", "article", "aside", "div class=ad", "a"]
    seen, cut = [], html.min_cut
    monkeypatch.setattr(html, "min_cut", lambda t, e: seen.append((t, e, cut(t, e))) or seen[-1][2])
    for _ in range(150):
        page = "".join(
            f"<{rng.choice(tags)}>" + "word " * rng.randrange(12) + f"</{rng.choice(tags).split()[0]}>" for _ in range(9)
        )
        html.labelled(page)
        t, e, side = seen.pop()

        def cost(side):
            c = sum(x for x, s in zip(t, side) if x > 0 and not s) + sum(-x for x, s in zip(t, side) if x < 0 and s)
            return c + sum(w for i, j, w in e if side[i] != side[j])

        assert cost(side) == min(cost([bool(m >> i & 1) for i in range(len(t))]) for m in range(1 << len(t)))


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        t = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(i, rng.randrange(i), rng.randrange(9)) for i in range(1, n) for _ in range(2)]

        def cost(side):
            c = sum(x for x, s in zip(t, side) if x > 0 and not s) + sum(-x for x, s in zip(t, side) if x < 0 and s)
            return c + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.min_cut(t, edges)) == best


def test_long_and_broken_pages_are_read_in_time():
    import time

    for page in ("<b>" * 100_000 + "x</div>" * 100_000, "<div>" * 100_000 + "<dt>x" * 100_000, "<p>x" * 50_000, "<a '" * 50_000, "<b>" * 50_000 + "</p>" * 50_000, "<" * 200_000,
                 "<article>" + "<p>word word</p><p><a>x</a></p>" * 20_000 + "</article>"):
        start = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - start < 8


def test_extract_keeps_rows(spark):
    rows = [(1, "u", ARTICLE, 5), (1, "u", ARTICLE, 5), (None, None, None, None), (2, None, "", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in html.extract(df).collect())
    assert got == [(0, "", 0), (1, "u", 49), (1, "u", 49), (2, "", 0)]
    assert html.extract(df.limit(0)).collect() == []


PAGES = [
    (1, "http://a.example/1", "x" * 1200), (2, None, "x" * 1200), (3, "http://b/\r\nWARC-Type: x", "é" * 700),
    (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "x" * 1200),
    (None, "v", "y" * 1000), (None, "w", "y" * 1000), (8, "z", "a\r\n\r\nWARC/1.1\r\n" * 300), (2, None, "x" * 1200),
]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, digest string")
    got = warc.archive_pages(df.repartition(3), f"file://{tmp_path}/w").collect()
    want = []
    largest: dict = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = largest.get(b)
        revisit = to is not None and i != to
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(((r[0], *r[2:]) for r in got), key=repr) == sorted(want, key=repr)
    # Every member is a gzip file of its own, and the index covers the file.
    for path in (tmp_path / "w" / "normal").glob("*.warc.gz"):
        data, at = path.read_bytes(), 0
        for line in (path.parent / (path.name + ".idx")).read_text().split("\n")[:-1]:
            start, size = map(int, line.split())
            assert start == at and gzip.decompress(data[start : start + size]).startswith(b"WARC/1.1\r\n")
            at += size
        assert at == len(data)
    assert warc.archive_pages(df.limit(0), f"file://{tmp_path}/none").collect() == []


def test_normaliser_reads_one_stream_or_many_members():
    records = [warc.record_bytes(i, "u", bytes([65 + i]) * (i * 70_000), hashlib.sha1(bytes([65 + i]) * (i * 70_000)).hexdigest(), None, False) for i in range(5)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        sink = io.BytesIO()
        index = list(warc.normalise_archive(io.BytesIO(data), sink))
        out = sink.getvalue()
        assert [gzip.decompress(out[a : a + n]) for a, n in index] == records
        assert [warc.read_member(out[a : a + n])[2] for a, n in index] == [i * 70_000 for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.normalise_archive(io.BytesIO(gzip.compress(records[3][:-9000])), io.BytesIO()))


def test_url_rules(spark):
    given = [
        "http://example.net/en/1", "HTTP://WWW.Example.NET/de?x://y", "http://notexample.net/en/", "http://net",
        "http://net/", "http://a.net?/en/", "http://example.com/de/x", "http://x.example.com/de", "http://m.org/fr/#a",
        "http://evilorg/fr/", "no scheme", "", None, "://", "http:///en/", "http://a.b.c.d.e.net/p", "http://ÄX.NET/",
        "http://net:80/", "http://net./", "http://a\nb.org/fr/", "http://x.net/a", "http://x.net/a",
    ]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(given)], "page_id int, url string, keys string")

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = rest[:cut].translate(brute.FOLD)
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        best = None
        for h, p, a in urls.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                best = (h + p, a)
        return host, path, best and best[0], best[1] if best else "allow"

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(given)}
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r["verdict"] for r in urls.judge_urls(df, none).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, urls.RULES)).collect() == []


def test_a_long_list_of_rules_has_several_blocks(spark):
    rules = [(f"h{i}.org", "/", "block") for i in range(3000)]
    df = spark.createDataFrame([(i, f"http://www.h{i}.org/x") for i in range(0, 6000, 7)], "page_id int, url string")
    got = urls.judge_urls(df, urls.rule_table(spark, rules)).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 3000) for r in got) and len(got) == 858


def mix_rows(seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 31, 200])), rng.choice("aaaaab") + rng.choice("xy")) for i in range(900)]
    rows += [(1000 + i, "w w", f"s{i % 7}") for i in range(60)] + [(None, "w", None), (None, None, None), (2000, "", "only-empty")]
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, bucket int").repartition(4)


def targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return size, target


def test_mix(spark):
    rows = mix_rows()
    got = mixing.mix(frame(spark, rows)).collect()
    size, target = targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 200 + 0.02 * target[s]
    again = mixing.mix(frame(spark, rows).repartition(9)).collect()
    key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    whole = mixing.mixed_documents(frame(spark, rows))
    assert whole.columns == ["doc_id", "text", "source", "bucket", "copy"]
    assert whole.count() == sum(r["copies"] for r in got)
    assert mixing.mix(frame(spark, []).limit(0)).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows, centres = [], rng.standard_normal((30, 16))
    for i in range(400):
        c = centres[i % 30] if i < 200 else rng.standard_normal(16)
        v = c + rng.standard_normal(16) * 0.12 * (i % 4)
        rows.append((i, [float(x) for x in v]))
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15)]
    rows += [(505, [float("inf")] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [1e300, 2e300]), rows[3], (None, rows[9][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, key int").repartition(3)
    got = sorted((tuple(r) for r in embeddings.near_vectors(df).collect()), key=repr)
    rows = [(i, [x / 1e300 for x in v] if i == 508 else v) for i, v in rows]
    want = sorted(brute.vectors(rows), key=repr)
    links = sum(r[1] for r in want)
    assert links > 200 and sum(r[1] for r in got) >= 0.98 * links
    same = sum(a == b for a, b in zip(got, want))
    assert same >= 0.97 * len(want)
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def _loose_and_dense(n: int, groups: int, dense: int, seed: int) -> np.ndarray:
    """``n`` vectors in loose groups around the threshold, then ``dense`` in one close group."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 32))
    loose = centres[rng.integers(groups, size=n)] + 0.16 * rng.standard_normal((n, 32))
    return np.concatenate([loose, centres[0] + 0.02 * rng.standard_normal((dense, 32))])


def _true_links(x: np.ndarray) -> np.ndarray:
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    links = unit @ unit.T >= embeddings.LINK
    np.fill_diagonal(links, False)
    return links


def test_graph_of_thousands_in_one_shard():
    """The walk through the graph finds the links that brute force finds, none else, and both
    ends of a link know it."""
    import time

    x = _loose_and_dense(3000, 300, 700, 3)
    exact = x / np.sqrt((x**2).sum(1))[:, None]
    index = embeddings.build(exact.astype(np.float32))
    assert len(index.nodes) > 3 * embeddings.BEAM and index.upper is not None
    beam = embeddings.audit(index, exact, embeddings.LINK)
    start = time.perf_counter()
    found = np.unpackbits(embeddings.links_between((index, exact, beam), None, embeddings.LINK), axis=1, count=len(x))
    assert time.perf_counter() - start < 60
    want = _true_links(x)
    assert (found == found.T).all() and not (found.astype(bool) & ~want).any()
    assert found.sum() >= 0.98 * want.sum()
    # Two shards: the same from either side.
    a, b = exact[:2000], exact[2000:]
    parts = [(embeddings.build(v.astype(np.float32)), v, embeddings.BEAM) for v in (a, b)]
    there = np.unpackbits(embeddings.links_between(*parts, embeddings.LINK), axis=1, count=len(b))
    back = np.unpackbits(embeddings.links_between(*parts[::-1], embeddings.LINK), axis=1, count=len(a))
    assert (there == back.T).all() and there.sum() >= 0.98 * want[:2000, 2000:].sum()


def test_near_vectors_of_one_shard(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARDS", 1)
    x = _loose_and_dense(1200, 150, 200, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df.repartition(3)).collect()}
    want = _true_links(x).sum(1)
    assert len(got) == len(x) and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.98 * want.sum() and sum(got.values()) % 2 == 0


def test_forest_joins_what_rows_join():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        rows = [(int(rng.integers(n)), rng.integers(n, size=int(rng.integers(1, 5)))) for _ in range(int(rng.integers(1, 12)))]

        def groups(pairs):
            label = list(range(n))
            for a, b in pairs:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
            return {tuple(i for i in range(n) if label[i] == c) for c in set(label)}

        edges = list(embeddings._forest(iter(rows), n))
        assert groups(edges) == groups([(a, int(b)) for a, near in rows for b in near]) and len(edges) < n
