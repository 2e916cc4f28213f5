"""Predictions of many systems, replaced one system at a time.

Every write of a system gets a folder of its own, and a manifest says which folder is the
current one of each system. Publishing is the creation of the next manifest, which either
succeeds or does not, so readers see all systems before or after a write, never half of
one, and writing one system does not touch the files of the others.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources import jsonl

MANIFESTS = "_manifests"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, where = _folder(spark, f"{path}/{MANIFESTS}")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The number of the newest manifest (0: none) and the folder of every system in it."""
    numbers = _numbers(spark, path)
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{path}/{MANIFESTS}/{numbers[-1]:08d}.json", wholetext=True).first()[0]
    return numbers[-1], json.loads(text)


def _publish(spark: SparkSession, path: str, number: int, folders: Mapping[str, str]) -> None:
    """Create manifest ``number``; fails if another writer has created it meanwhile."""
    files, where = _folder(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = files.create(where, False)
    out.write(bytearray(json.dumps(dict(folders), sort_keys=True).encode()))
    out.close()
    _, target = _folder(spark, f"{path}/{MANIFESTS}/{number:08d}.json")
    if files.exists(target) or not files.rename(where, target):
        files.delete(where, False)
        raise RuntimeError(f"another writer has published manifest {number} of {path}")


def replace_systems(spark: SparkSession, parts: Mapping[str, DataFrame], path: str) -> None:
    """Write the rows of every system named in ``parts`` and make them its current ones, all
    at once; other systems stay as they are. The data of a failed write is never read."""
    number, folders = current(spark, path)
    for system, df in parts.items():
        folder = f"data/{uuid.uuid4().hex}"
        jsonl.write_jsonl(df.drop("system"), f"{path}/{folder}")
        folders[system] = folder
    _publish(spark, path, number + 1, folders)


def remove_system(spark: SparkSession, path: str, system: str) -> None:
    """Leave a system out from now on; its files stay until ``vacuum``."""
    number, folders = current(spark, path)
    if system not in folders:
        raise KeyError(system)
    _publish(spark, path, number + 1, {s: f for s, f in folders.items() if s != system})


def read_systems(
    spark: SparkSession, path: str, schema: str = "id BIGINT, text STRING, label STRING, error STRING"
) -> DataFrame:
    """The current rows of all systems, with ``system``. It follows the manifest as it is now;
    later writes do not change what this DataFrame reads."""
    _, folders = current(spark, path)
    out = None
    for system, folder in sorted(folders.items()):
        own = jsonl.typed(spark.read.schema(jsonl.open_schema(schema)).json(f"{path}/{folder}"), schema)
        own = own.withColumn("system", F.lit(system))
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], f"{schema}, system STRING") if out is None else out


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove folders that the current manifest does not name, and older manifests; returns
    the folders removed. Not while a write or a read of an older manifest goes on."""
    number, folders = current(spark, path)
    files, where = _folder(spark, f"{path}/data")
    gone = []
    for status in files.listStatus(where) if files.exists(where) else []:
        name = f"data/{status.getPath().getName()}"
        if name not in folders.values():
            files.delete(status.getPath(), True)
            gone.append(name)
    for old in _numbers(spark, path):
        if old < number:
            files.delete(_folder(spark, f"{path}/{MANIFESTS}/{old:08d}.json")[1], False)
    return sorted(gone)
