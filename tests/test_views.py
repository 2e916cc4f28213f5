"""The label views derived from the documents."""

import json
import re
import time

from gradeloom.settings import CRITERIA
from gradeloom.sources import views


def _slices(text, shift):
    k, n = len(CRITERIA), len(text)
    cuts = [(n * i // k, n * (i + 1) // k) for i in range(k)]
    return [re.sub("[^A-Za-z ]", " ", text[a + shift : b + shift]).strip(" ") for a, b in cuts]


def _write(spark, path, texts):
    rows = [(i, t, len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_feedback_is_the_sliced_text(spark, tmp_path):
    every = "".join(map(chr, [*range(0x250), 0x4E2D, 0xFFFD, 0x1F600, 0x10FFFF]))
    texts = ["", "ab, c", every, "Zwölf\n[Boxer]`_{}~ @" * 9, None, "\x00 z\U0001F600y" * 7]
    sf = _write(spark, tmp_path, texts)
    want = {0: _slices("", 0)} | {i: _slices(t, 0) for i, t in enumerate(texts) if t}
    for r in views.label_gt(spark, sf).collect():
        got = json.loads(r.label)
        assert [got[t]["feedback"] for t in CRITERIA] == want[r.id] if texts[r.id] is not None else got == {}
    for r in views.label_pred(spark, sf).where("system = 'sys2'").collect():
        got = json.loads(r.label)
        if texts[r.id] is not None:
            assert [got[t]["feedback"] for t in CRITERIA] == _slices(texts[r.id], 2)


def test_views_of_long_texts_are_quick(spark, tmp_path):
    sf = _write(spark, tmp_path, ["some words, and more. " * 100_000] * 6)
    begin = time.time()
    views.label_gt(spark, sf), views.label_pred(spark, sf)
    assert time.time() - begin < 15
