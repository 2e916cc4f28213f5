"""Cleaning new files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gradeloom.functions import labels as L
from gradeloom.operators.labels import clean_labels, with_reason
from gradeloom.settings import CRITERIA
from gradeloom.sources.jsonl import (
    RECORD_SCHEMA,
    WRITTEN,
    open_records,
    open_schema,
    scan_records,
    typed,
    write_jsonl,
)


def clean_stream(
    spark: SparkSession,
    folder: str,
    criteria: Sequence[str] = CRITERIA,
    schema: str | StructType = RECORD_SCHEMA,
    pattern: str = "*.jsonl",
) -> DataFrame:
    """Valid, repaired rows of the JSONL files that appear in ``folder``, opened as the batch
    scan of a folder opens them."""
    files = spark.readStream.schema(open_schema(schema)).option("pathGlobFilter", pattern)
    return clean_labels(typed(files.json(folder), schema), criteria)


def append_clean_incremental(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    criteria: Sequence[str] = CRITERIA,
    pattern: str = "*.jsonl",
) -> StreamingQuery:
    """Clean the files not yet seen, append to ``output`` and stop. Running it again adds
    nothing; the checkpoint makes each file count once, also after a failure."""
    return (
        clean_stream(spark, folder, criteria, pattern=pattern)
        .writeStream.format("json")
        .option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", "false")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(output)
    )


NOT_STRICT = "Not strictly valid"
NO_KEY = "No id"


def judge_strictly(df: DataFrame, criteria: Sequence[str] = CRITERIA, key: str = "id") -> DataFrame:
    """Every row with ``rejected``: NULL if cleaning keeps it, else why not. A kept row has
    the repaired text in place of a label that needed repair."""
    judged = with_reason(df, criteria, fix="simple")
    ok = L.strict_ok("parsed", criteria)
    why = F.when(F.col(key).isNull(), NO_KEY).when(~F.coalesce(ok, F.lit(False)), F.coalesce("reason", F.lit(NOT_STRICT)))
    label = F.when(F.col("rejected").isNull(), F.col("parsed_text")).otherwise(F.col("label"))
    return judged.withColumn("rejected", why).withColumn("label", label).select(*df.columns, "rejected")


def clean_with_rejects(
    spark: SparkSession,
    folder: str,
    output: str,
    rejects: str,
    checkpoint: str,
    criteria: Sequence[str] = CRITERIA,
    schema: str | StructType = RECORD_SCHEMA,
    pattern: str = "*.{json,jsonl,txt}",
    compression: str = "none",
) -> StreamingQuery:
    """Clean the files not yet seen, valid rows to ``output`` and the others to ``rejects``
    with ``rejected``, the reason; then stop. Unread keys of the records stay with them.
    ``compression`` is that of the files written, as in ``write_jsonl``.

    Both sinks have a folder per micro-batch, named by its id, and a batch replaces its
    folders. A batch that failed between or within the two sinks is repeated by the next run
    and writes the same folders again, so every row counts once, in one of the sinks.
    """
    codec = {} if compression == "none" else {"compression": compression}

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = judge_strictly(batch, criteria).persist()
        try:
            kept = judged.where("rejected IS NULL").drop("rejected")
            write_jsonl(kept, f"{output}/batch={batch_id}", **codec)
            rejected = judged.where("rejected IS NOT NULL")
            write_jsonl(rejected, f"{rejects}/batch={batch_id}", **codec)
        finally:
            judged.unpersist()

    lines = spark.readStream.schema("value STRING").option("pathGlobFilter", pattern).text(folder)
    rows = open_records(lines, schema).drop("source_file")
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def scan_batches(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """What the micro-batches have written to one of the sinks, with ``batch``."""
    return scan_records(spark, [path], schema, WRITTEN, partitions=["batch"]).drop("source_file")
