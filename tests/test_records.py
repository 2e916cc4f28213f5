"""Keys that no schema names stay with their record."""

import json

from pyspark.sql import functions as F

from gradeloom.plans import preparation
from gradeloom.settings import CRITERIA
from gradeloom.sources import jsonl

LABEL = json.dumps({t: {"score": 4, "feedback": "fine"} for t in CRITERIA})


def written(path, records):
    path.mkdir()
    lines = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records]
    (path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def stored(spark, path):
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


ODD = {"a.b": 1, "é'\"$['x']": [None, {"deep": {"n": 1.5}}], "": "empty", "0": True, "big": 10**30}


def test_unread_keys_come_back(spark, tmp_path):
    records = [
        {"id": 1, "text": "a", "label": "x", "trait": "t", **ODD},
        {"id": 2, "text": "b", "label": None},
        {"only": "unread"},
        {"id": "7", "text": "c", "label": {"o": 1}, "rest": {"rest": 2}},
    ]
    folder = written(tmp_path / "in", [*records, "", "  \t", "broken {", "[1]"])
    df = jsonl.scan_records(spark, [folder])
    assert df.columns == ["id", "text", "label", "trait", "rest", "source_file"]
    assert df.count() == 6
    jsonl.write_jsonl(df.drop("source_file"), str(tmp_path / "out"))
    got = sorted(stored(spark, str(tmp_path / "out")), key=lambda r: (r["id"] is None, r["id"] or 0, len(r)))
    none = {"id": None, "text": None, "label": None, "trait": None}
    assert got == [
        {**none, **records[0]}, {**none, **records[1]},
        {**none, "id": 7, "text": "c", "rest": {"rest": 2}}, none, none, {**none, "only": "unread"},
    ]


def test_a_column_wins_over_a_key_of_its_name(spark, tmp_path):
    folder = written(tmp_path / "in", [{"id": 1, "split": "old", "extra": 1}])
    df = jsonl.scan_records(spark, [folder]).withColumns({"split": F.lit("a b%+'"), "note": F.lit(3)})
    jsonl.write_partitioned(df.drop("source_file"), str(tmp_path / "out"), "split")
    assert stored(spark, str(tmp_path / "out")) == [
        {"id": 1, "text": None, "label": None, "trait": None, "note": 3, "extra": 1}
    ]
    back = jsonl.scan_split(spark, str(tmp_path / "out"), "split").select("id", "split", F.to_json("rest").alias("r")).first()
    assert (back.id, back.split, json.loads(back.r)) == (1, "a b%+'", {"note": 3, "extra": 1})


def test_without_unread_keys(spark, tmp_path):
    folder = written(tmp_path / "in", [{"id": 1, "text": "a"}])
    df = jsonl.scan_records(spark, [folder], "id BIGINT, text STRING")
    assert df.first().rest is None
    jsonl.write_jsonl(df.select("rest"), str(tmp_path / "none"))
    assert stored(spark, str(tmp_path / "none")) == [{}]
    assert jsonl.scan_records(spark, [written(tmp_path / "empty", [])]).count() == 0


def test_same_columns_as_the_folder_scan(spark, tmp_path):
    records = [{"id": i, "text": f"t{i}", "label": LABEL if i % 2 else {"o": i}, "n": {"i": [i]}} for i in range(20)]
    folder = written(tmp_path / "in", records)
    own = ["id", "text", "label", "trait", "source_file"]
    assert sorted(map(tuple, jsonl.scan_records(spark, [folder]).select(own).collect())) == sorted(
        map(tuple, jsonl.scan_folders(spark, [folder]).select(own).collect())
    )


def test_prepared_corpus_keeps_them(spark, tmp_path):
    records = [{"id": i, "text": f"t{i}", "label": LABEL, "meta": {"n": [i, {"x": str(i)}]}} for i in range(60)]
    folder = written(tmp_path / "in", records)
    out = preparation.clean_and_split(spark, [folder], str(tmp_path / "out"))
    rows = out.select("id", "split", F.to_json("rest").alias("r")).collect()
    assert {r.split for r in rows} == {"train", "val", "test"} and len(rows) == 60
    assert all(json.loads(r.r) == {"meta": {"n": [r.id, {"x": str(r.id)}]}} for r in rows)
