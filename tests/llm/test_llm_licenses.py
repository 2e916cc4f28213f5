"""License scans: against a plain restatement, the rules' own invariants, edge cases."""

import random
import re
from re import _constants as C
from re import _parser

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import licenses
from gradeloom.llm.license_rules import ANCHORS, BASE, rules, spaced

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """All rules over all words; a match is dropped by any match that outranks and holds it."""
    words = WORD.findall((text or "").translate(FOLD))
    t = "".join(f" {w} " for w in words)
    hits = []
    for rank, r in enumerate(rules()):
        for m in re.finditer(r.pattern, t):
            start = t[: m.start()].count(" ") // 2
            hits.append((start, start + m.group().count(" ") // 2, r.level, rank, r))

    def beaten(h):
        def beats(g):
            if g is h or g[0] > h[0] or g[1] < h[1] or g[2] > h[2]:
                return False
            return g[2] < h[2] or (g[0], g[1]) != (h[0], h[1]) or g[3] < h[3]

        return any(beats(g) for g in hits)

    kept = [h for h in hits if not beaten(h)]
    base = [h for h in hits if h[4].base]
    return (
        len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
        ",".join(sorted({h[4].label for h in base})), ",".join(sorted({h[4].label for h in kept + base})),
        max((h[4].weight for h in kept + base), default=0.0), len(kept),
    )


def shortest(tree):
    """Text of the shortest match, and the runs of characters that are in every match."""
    text, runs = "", [""]
    for op, arg in tree:
        if op is C.LITERAL:
            text, runs[-1] = text + chr(arg), runs[-1] + chr(arg)
        elif op is C.SUBPATTERN:
            part, inner = shortest(arg[-1])
            text, runs = text + part, [*runs[:-1], runs[-1] + inner[0], *inner[1:]]
        elif op is C.MAX_REPEAT:
            if arg[0]:
                text += shortest(arg[2])[0] * arg[0]
            runs.append("")
        elif op is C.BRANCH:
            text += min((shortest(x)[0] for x in arg[1]), key=len)
            runs.append("")
        elif op is C.IN:
            text += chr(arg[0][1]) if arg[0][0] is C.LITERAL else "0" if arg[0][0] is C.RANGE else "x"
            runs.append("")
        else:
            raise ValueError(op)
    return text, runs


def test_every_rule_is_found_through_its_keyword_and_an_anchor():
    assert len(rules()) >= 250
    for r in rules():
        text, runs = shortest(_parser.parse(r.pattern))
        assert re.fullmatch(r.pattern, text), r
        assert any(r.keyword in run for run in runs), (r.pattern, r.keyword)
        assert any(spaced(a) in run for a in ANCHORS for run in runs), r.pattern
        assert not re.search(r"  +$|^  ", text) and "   " not in text, r


def frame(spark, texts, ddl="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], ddl)


def scanned(spark, texts):
    out = licenses.scan(frame(spark, texts)).drop("detections").orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in out]


def test_equals_plain_matching(spark):
    rng = random.Random(5)
    examples = [shortest(_parser.parse(r.pattern))[0].split() for r in rules()]
    glue = ["the", "É", "gnu", "cc", "by", "license", "Version", "2", "0", "mit", "public", "ımit", "(c)", "under"]
    texts = []
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 9)):
            words += rng.choice(examples) if rng.random() < 0.6 else [rng.choice(glue)]
        texts.append("".join(w.upper() + rng.choice([" ", "\n", "-", ", ", "  "]) if rng.random() < 0.3 else w + " " for w in words))
    assert scanned(spark, texts) == [plain(t) for t in texts]


def test_every_rule_is_found(spark):
    texts = [shortest(_parser.parse(r.pattern))[0] for r in rules()]
    got = scanned(spark, texts)
    assert got == [plain(t) for t in texts]
    assert all(g[5] for g in got)


@pytest.mark.parametrize(
    "text, base, labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-nc-4.0"),
        ("the GNU Lesser General Public License v3", "gpl", "gpl,lgpl-3.0"),
        ("General public license; ALL\nrights-reserved", "gpl,reserved", "gpl,reserved"),
        ("in mit der license", "", ""),
        ("ACC BY-NC", "", ""),
        ("SPDX-License-Identifier: Apache-2.0", "", "apache-2.0"),
        ("https://creativecommons.org/licenses/by-sa/4.0/", "", "cc-by-sa-4.0"),
        ("K all rights reserved", "reserved", "reserved"),
        ("aİ mit licenſe", "", ""),
    ],
)
def test_examples(spark, text, base, labels):
    got = scanned(spark, [text])[0]
    assert got[4:6] == (base, labels) and got == plain(text)


def test_very_long_text_with_many_matches(spark):
    text = "All rights reserved. CC BY-NC 4.0 " * 20_000 + "x" * 1_000_000
    n, base, first, last, labels, every, score, kept = scanned(spark, [text])[0]
    assert (n, base, first, last) == (160_001, 40_000, 0, 159_995 + 0)
    assert labels == "cc-by,reserved" and every == "cc-by,cc-by-nc-4.0,reserved" and score == 1.0
    assert kept == 40_000


def test_edge_cases(spark):
    texts = [None, "", " \n\t", "...", "all rights reserved", "all rights reserved", "é" * 50]
    assert scanned(spark, texts) == [plain(t) for t in texts]
    assert licenses.scan(frame(spark, [])).count() == 0
    clash = frame(spark, ["cc by 4.0"]).withColumns({c: F.lit("x") for c in ("_t", "hits", "base", "_keep", "_rules", "walk", "_low")})
    got = licenses.scan(clash, keep=("doc_id", "_t", "hits", "base", "_keep", "_rules")).first()
    assert got["_t"] == got["hits"] == got["base"] == "x" and got["labels"] == "cc-by,cc-by-4.0"
    odd = spark.createDataFrame([("b", "cc by"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.n_base) for r in licenses.scan(odd).collect()} == {("b", 1), (None, 0)}


def test_stays_in_one_jvm_stage(spark):
    plan = licenses.scan(frame(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert set(BASE.values()) <= {r.label for r in rules() if r.base}
