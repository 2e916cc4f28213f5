"""Run models over a test file and store predictions by system."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.infer import Model, infer_many_systems
from gradeloom.settings import CRITERIA
from gradeloom.sources import jsonl, store


def predict_file(
    spark: SparkSession,
    test_path: str,
    output: str,
    systems: Mapping[str, Callable[[], Model]],
    criteria: Sequence[str] = CRITERIA,
    batch_size: int = 128,
) -> DataFrame:
    """Scan, prompt, infer and store the predictions of the named systems; returns the stored
    rows of all systems. Systems stored before under other names stay untouched, so a rerun
    of one checkpoint costs one checkpoint."""
    test = jsonl.scan_skip_blank(spark, test_path, jsonl.RAW_SCHEMA)
    parts = {s: infer_many_systems(test, {s: f}, criteria, batch_size) for s, f in systems.items()}
    store.replace_systems(spark, parts, output)
    return store.read_systems(spark, output)
