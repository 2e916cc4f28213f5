"""JSONL readers and writers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, VariantType

from gradeloom.functions.labels import NOT_AN_OBJECT, OUTER_ERROR
from gradeloom.functions.text import strip
from gradeloom.operators.history import running_start
from gradeloom.operators.labels import evaluate_once, parse_label
from gradeloom.session import materialize

RECORD_SCHEMA = "id BIGINT, text STRING, label STRING, trait STRING"
RAW_SCHEMA = "id BIGINT, text STRING"
WRITTEN = "*.{json,jsonl,txt}{,.gz}"  # part files of the writers below


def scan_folders(
    spark: SparkSession,
    folders: Sequence[str],
    schema: str | StructType = RECORD_SCHEMA,
    pattern: str = "*.jsonl",
) -> DataFrame:
    """All files of the folders that match, as one DataFrame, plus ``source_file``."""
    reader = spark.read.schema(open_schema(schema)).option("pathGlobFilter", pattern)
    df = reader.json(list(folders)).select("*", F.col("_metadata.file_path").alias("source_file"))
    return typed(df, schema)


def scan_records(
    spark: SparkSession,
    folders: Sequence[str],
    schema: str | StructType = RECORD_SCHEMA,
    pattern: str = "*.{json,jsonl,txt}",
    partitions: Sequence[str] = (),
) -> DataFrame:
    """As ``scan_folders``, and ``rest``: the keys of a record that the schema does not name,
    nested values included, as one VARIANT object; NULL if there are none.

    A line is read as one VARIANT, from which the columns are taken, so nothing of a record is
    lost. ``write_jsonl`` and ``write_partitioned`` put ``rest`` back beside the columns. A
    line that is not a JSON object has only NULLs; blank lines are no records. ``partitions``
    are columns that the names of sub-folders hold, as text.
    """
    whole = StructType([StructField(c, StringType()) for c in ("value", *partitions)])
    lines = spark.read.schema(whole).option("pathGlobFilter", pattern).text(list(folders))
    return open_records(lines, schema, partitions)


def open_records(
    lines: DataFrame, schema: str | StructType = RECORD_SCHEMA, partitions: Sequence[str] = ()
) -> DataFrame:
    """The records of a text source's lines, of a batch or of a stream: see ``scan_records``."""
    lines = lines.where(strip(F.col("value")) != "").select(
        F.inline(F.array(F.struct(F.expr("try_parse_json(value)").alias("record")))),
        F.col("_metadata.file_path").alias("source_file"),
        *partitions,
    )
    kinds = _kinds(schema)
    named = ", ".join(_literal(f.name) for f in kinds)
    unread = F.expr(
        f"map_filter(try_cast(record AS MAP<STRING, VARIANT>), (k, v) -> NOT array_contains(array({named}), k))"
    )
    free = [f.name for f in open_schema(schema) if isinstance(f.dataType, VariantType)]
    columns = [
        F.expr(
            f"try_variant_get(record, {_literal(_path(f.name))}, "
            f"'{'variant' if f.name in free else f.dataType.simpleString()}')"
        ).alias(f.name)
        for f in kinds
    ]
    df = evaluate_once(lines, unread.alias("_unread")).select(
        *columns,
        F.when(F.size("_unread") > 0, F.to_variant_object("_unread")).alias("rest"),
        "source_file",
        *partitions,
    )
    return typed(df, schema)


def scan_split(spark: SparkSession, path: str, column: str, schema: str | StructType = RECORD_SCHEMA) -> DataFrame:
    """What ``write_partitioned`` has written: the records, ``rest`` and ``column``."""
    return scan_records(spark, [path], schema, WRITTEN, partitions=[column]).drop("source_file")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path(key: str) -> str:
    """A JSON path to one key, whatever characters it has."""
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def _kinds(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def open_schema(schema: str | StructType) -> StructType:
    """``schema`` with ``id`` and ``label`` read as they are, whatever their JSON type."""
    free = ("id", "label")
    fields = [StructField(f.name, VariantType()) if f.name in free else f for f in _kinds(schema)]
    return StructType(fields)


def typed(df: DataFrame, schema: str | StructType) -> DataFrame:
    """A label that is not a JSON string is NULL, so it is never taken for valid text. An id
    is converted to its declared type; declared as STRING it may be text or a number."""
    new = {}
    for f in _kinds(schema):
        if f.name == "label":
            text = F.schema_of_variant("label") == "STRING"
            new["label"] = F.when(text, F.try_variant_get("label", "$", "string"))
        elif f.name == "id":
            new["id"] = F.try_variant_get("id", "$", f.dataType.simpleString())
    return df.withColumns(new)


def scan_skip_blank(
    spark: SparkSession, paths: str | Sequence[str], schema: str | StructType = RECORD_SCHEMA
) -> DataFrame:
    """Records of the non-blank lines. A line that is not JSON fails the read."""
    lines = spark.read.text(paths).where(strip(F.col("value")) != "")
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(F.inline(F.array(record)))


def scan_column_stripped(df: DataFrame, column: str = "text") -> DataFrame:
    """One column, stripped. Nothing else is read from a columnar source."""
    return df.select(strip(F.col(column)).alias(column))


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """``split, value`` and what identifies the file split a line comes from."""
    place = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").cast("double").alias("changed"),
    ]
    return spark.read.text(path).select(*place, "value")


def _first_lines(splits: DataFrame) -> DataFrame:
    """``splits(file, block, lines, ..)`` with ``first``, the number of the split's first line.

    Files are numbered through in the order of the number in their names, then of the names,
    by a prefix scan over the splits.
    """
    number = F.expr(r"try_cast(regexp_extract(file, '([0-9]+)[^/]*$', 1) AS DECIMAL(38))")
    numbered = splits.withColumns({"_all": F.lit(0), "_number": number})
    placed = running_start(numbered, "_all", ["_number", "file", "block"], "lines")
    return placed.drop("_all", "_number").withColumnRenamed("start", "first")


def build_line_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Count the lines of every file split of ``path`` and write ``index``: ``file, block, size,
    changed, lines, first``. Only the counts are aggregated; no line is stored or sorted."""
    splits = _splits(spark, path).groupBy("file", "block", "size", "changed").agg(F.count("*").alias("lines"))
    _first_lines(splits).write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``split, value`` with ``offset``: how many lines of its split come before it. Lines of a
    split reach a task together and in file order."""
    last, n = None, 0
    for batch in batches:
        split = batch.column(0).to_numpy()
        if not len(split):
            continue
        new = np.empty(len(split), bool)
        new[0], new[1:] = split[0] != last, split[1:] != split[:-1]
        at = np.arange(len(split))
        begin = np.maximum.accumulate(np.where(new, at, -1))
        offset = np.where(begin < 0, at + n, at - begin)
        last, n = split[-1], int(offset[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset)], ["split", "value", "offset"])


def scan_lines_by_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """As ``scan_lines_with_position``, by a stored index, which is built if it is not there.

    The number of a line is its split's first number plus its offset in the split, so lines are
    read where they are, by any number of scans, and never stored again. A file that has
    changed since it was indexed, or is cut into other splits than then, fails the read: its
    line numbers would be wrong. Build the index again then.
    """
    try:
        known = spark.read.parquet(index)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = build_line_index(spark, path, index)
    split = F.xxhash64("file", "block", "size", "changed").alias("split")
    lines = _splits(spark, path).select(split, "value")
    lines = lines.mapInArrow(_numbered, "split bigint, value string, offset bigint")
    message = "a line's file split is not in the index: the file has changed, or is cut otherwise"
    pos = F.when(F.col("first").isNull(), F.raise_error(F.lit(message))).otherwise(F.col("first") + F.col("offset"))
    joined = lines.join(known.select(split, "first"), "split", "left")
    return joined.select(pos.cast("bigint").alias("pos"), "value")


def scan_lines_with_position(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value``: raw lines with their 0-based line number.

    ``path`` is a file, or a folder of part files that are numbered through in the order of
    the number in their names, then of the names. Within a file split rows come in file
    order, so a line number is the number of lines in the earlier splits plus the offset in
    its own split. The lines are read once and stored with their split, since another scan
    could cut files elsewhere; ``scan_lines_by_index`` does without. One row per split is
    aggregated and summed up; the lines themselves are neither sorted nor gathered. A line of
    an unknown split is an error.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.monotonically_increasing_id().alias("row"),
    )
    lines = materialize(scan, "lines")
    splits = lines.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("lines"))
    offsets = _first_lines(splits).select("file", "block", (F.col("first") - F.col("first_row")).alias("shift"))
    offsets = materialize(offsets, "line-offsets")
    known = F.when(
        F.col("shift").isNull(), F.raise_error(F.lit("a line's file split is unknown"))
    ).otherwise(F.col("row") + F.col("shift"))
    return lines.join(offsets, ["file", "block"], "left").select(known.alias("pos"), "value")


def records_of_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Open each line: ``id, text, label`` and ``line_error`` (NULL for a usable record).

    A line that is not JSON, is not an object or has no label is kept, as an error row.
    """
    df = parse_label(lines, label=value, out="record")
    rec = F.col("record")

    def field(name: str, kind: str = "string"):
        return F.try_variant_get(rec, f"$.{name}", kind)

    label_kind = F.schema_of_variant(field("label", "variant"))
    error = F.when(label_kind.isNull(), OUTER_ERROR).when(label_kind != "STRING", NOT_AN_OBJECT)
    out = evaluate_once(
        df,
        field("id", "bigint").alias("id"),
        field("text").alias("text"),
        F.when(label_kind == "STRING", field("label")).alias("label"),
        error.alias("line_error"),
    )
    return out.select(*lines.columns, "id", "text", "label", "line_error")


def scan_systems(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``system, pos, value`` for several prediction files, one per system."""
    parts = [
        scan_lines_with_position(spark, p).select(F.lit(s).alias("system"), "pos", "value")
        for s, p in paths.items()
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def write_lines_in_order(lines: DataFrame, order_by: str, path: str, compression: str = "none") -> None:
    """A column ``value`` as a folder of text files whose name order is the row order.
    ``compression`` is a codec of Spark's text source; a compressed file is read by one task."""
    ranged = lines.repartitionByRange(order_by).sortWithinPartitions(order_by)
    ranged.select("value").write.mode("overwrite").text(path, compression=compression)


def _whole_records(df: DataFrame, rest: str, apart: Sequence[str] = ()) -> DataFrame:
    """``value``: the record of a row as JSON text, its columns first and then the keys of
    ``rest``; a column wins over a key of its name. ``apart`` stay columns."""
    own = [c for c in df.columns if c not in (rest, *apart)]
    named = ", ".join(_literal(c) for c in [*own, *apart])
    more = F.expr(
        f"map_filter(try_cast(`{rest}` AS MAP<STRING, VARIANT>), (k, v) -> NOT array_contains(array({named}), k))"
    )
    known, extra = F.col("_known"), F.col("_extra")
    df = df.select(
        *apart,
        F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("_known"),
        F.when(F.size(more) > 0, F.to_json(more)).alias("_extra"),
    )
    comma = F.lit("," if own else "")
    both = F.concat(F.expr("left(_known, length(_known) - 1)"), comma, F.expr("substr(_extra, 2)"))
    return df.select(*apart, F.when(extra.isNull(), known).otherwise(both).alias("value"))


def write_jsonl(df: DataFrame, path: str, rest: str = "rest", compression: str = "none") -> None:
    """Replace whatever is at ``path``. The keys of a VARIANT column ``rest`` become keys of
    the records, in part files that end in ``.txt``; without one they end in ``.json``. With a
    ``compression`` (a codec of Spark's text source) its suffix follows, such as ``.json.gz``."""
    if _has_rest(df, rest):
        _whole_records(df, rest).write.mode("overwrite").text(path, compression=compression)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def _has_rest(df: DataFrame, rest: str) -> bool:
    return rest in df.columns and isinstance(df.schema[rest].dataType, VariantType)


def write_partitioned(
    df: DataFrame, path: str, column: str, rest: str = "rest", compression: str = "none"
) -> None:
    """One sub-folder per value of ``column`` (``split`` or ``system``); every task writes
    its own rows, so a large group is not gathered first. ``rest`` and ``compression`` as in
    ``write_jsonl``."""
    if _has_rest(df, rest):
        whole = _whole_records(df, rest, [column]).write.mode("overwrite").partitionBy(column)
        whole.text(path, compression=compression)
        return
    rows = df.write.mode("overwrite").partitionBy(column).option("ignoreNullFields", "false")
    rows.json(path, compression=compression)
