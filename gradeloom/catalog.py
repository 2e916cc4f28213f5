"""The named queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import stubs
from gradeloom.functions import jsontext as J
from gradeloom.functions import labels as L
from gradeloom.functions import prompts as P
from gradeloom.functions import text as TX
from gradeloom.operators import align as A
from gradeloom.operators import (
    augment,
    engine,
    history,
    infer,
    ledger,
    match,
    metrics,
    sample,
    sft,
)
from gradeloom.operators import labels as O
from gradeloom.operators import split as S
from gradeloom.session import Scratch, materialize, prepare, scratch_path
from gradeloom.settings import CRITERIA, THRESHOLD
from gradeloom.sources import jsonl, report, store, views
from gradeloom.streaming import clean as stream
from gradeloom.streaming.clean import append_clean_incremental as run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SWEEP = (3, 5, 6, 8)
HEAD_N = 100
DRAWS = 200
AUGMENT_DRAWS = 50
HISTORY_TOKENS = 200
TRAITS_TO_AUGMENT = tuple(P.PERSONAS)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _validated(spark, sf_dir) -> DataFrame:
    return O.validate_lenient(views.label_pred(spark, sf_dir))


def _aligned(spark, sf_dir, with_feedback=False) -> DataFrame:
    return A.align(
        views.label_pred(spark, sf_dir),
        views.label_gt(spark, sf_dir),
        views.SYSTEMS,
        with_feedback=with_feedback,
    )


def _keyed(spark, sf_dir) -> DataFrame:
    """Keyed rows, written once: finding the cuts and labelling rows both read that."""
    return materialize(S.with_strat_key(views.label_gt(spark, sf_dir)), "keyed")


def _split(spark, sf_dir) -> DataFrame:
    return S.stratified_split(_keyed(spark, sf_dir))


def _docs(spark, sf_dir) -> DataFrame:
    return views.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def _texts(labels: DataFrame, spark, sf_dir) -> DataFrame:
    return views.with_text(labels, spark, sf_dir)


# --- sources and sinks -------------------------------------------------------------------


@query
def scan_jsonl_folder(spark, sf_dir):
    preds = _texts(views.label_pred(spark, sf_dir), spark, sf_dir).withColumnRenamed("system", "trait")
    root = scratch_path(spark, "folders")
    jsonl.write_jsonl(preds.where("trait = 'sys0'"), f"{root}/a", compression="gzip")
    jsonl.write_jsonl(preds.where("trait <> 'sys0'"), f"{root}/b", compression="gzip")
    df = jsonl.scan_folders(spark, [f"{root}/a", f"{root}/b"], pattern="*.json.gz")
    return df.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", "trait")


@query
def scan_unread_keys(spark, sf_dir):
    """Keys that no schema names, through scan, clean, split, write and scan."""
    labels = views.label_gt(spark, sf_dir)
    docs = views.documents(spark, sf_dir)
    records = labels.join(docs, labels.id == docs.doc_id).select(
        F.to_json(
            F.struct(
                "id", "text", "label",
                F.struct("lang", F.struct("source", "n_chars").alias("origin")).alias("meta"),
                F.when(F.col("id") % 3 == 0, F.array("id", F.lit(1))).alias("note"),
            )
        ).alias("value")
    )
    root = scratch_path(spark, "unread")
    records.write.text(f"{root}/in", compression="gzip")
    rows = O.project_labeled(jsonl.scan_records(spark, [f"{root}/in"], pattern="*.txt.gz"), keep=("rest",))
    keyed = materialize(S.with_strat_key(O.clean_labels(rows)), "keyed")
    split = S.stratified_split(keyed).drop("strat_key")
    jsonl.write_partitioned(split, f"{root}/out", "split", compression="gzip")
    df = jsonl.scan_split(spark, f"{root}/out", "split")
    return df.select(
        "id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", "split",
        F.expr("try_variant_get(rest, '$.meta.lang', 'string')").alias("lang"),
        F.expr("try_variant_get(rest, '$.meta.origin.source', 'string')").alias("source"),
        F.expr("try_variant_get(rest, '$.meta.origin.n_chars', 'bigint')").alias("n_chars"),
        F.expr("try_variant_get(rest, '$.note[0]', 'bigint')").alias("note"),
    )


@query
def scan_jsonl_skip_blank(spark, sf_dir):
    path = scratch_path(spark, "blank")
    record = F.to_json(F.struct("id", "text"))
    lines = _docs(spark, sf_dir).select(
        F.explode(F.array(F.lit(""), record, F.lit("  \t"))).alias("value")
    )
    lines.write.text(path)
    df = jsonl.scan_skip_blank(spark, path, jsonl.RAW_SCHEMA)
    return df.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _line_of(df: DataFrame) -> Column:
    """A JSONL record; every 16th is broken and every 16th is blank."""
    record = F.to_json(F.struct("id", "text", "label"))
    return F.when(F.col("id") % 16 == 3, F.lit('{"id": 1, "text"')).when(
        F.col("id") % 16 == 5, F.lit("")
    ).otherwise(record)


@query
def scan_lines_with_position(spark, sf_dir):
    gt = _texts(views.label_gt(spark, sf_dir), spark, sf_dir)
    path = scratch_path(spark, "lines")
    jsonl.write_lines_in_order(gt.select("id", _line_of(gt).alias("value")), "id", path)
    df = jsonl.records_of_lines(jsonl.scan_lines_with_position(spark, path))
    return df.select("pos", "id", "label", F.col("line_error").alias("reason"))


@query
def scan_lines_by_index(spark, sf_dir):
    """The second scan of a file set by its stored index."""
    gt, root = _texts(views.label_gt(spark, sf_dir), spark, sf_dir), scratch_path(spark, "indexed")
    jsonl.write_lines_in_order(gt.select("id", _line_of(gt).alias("value")), "id", f"{root}/in")
    jsonl.build_line_index(spark, f"{root}/in", f"{root}/index")
    df = jsonl.records_of_lines(jsonl.scan_lines_by_index(spark, f"{root}/in", f"{root}/index"))
    return df.select("pos", "id", "label", F.col("line_error").alias("reason"))


@query
def scan_column_stripped(spark, sf_dir):
    df = jsonl.scan_column_stripped(views.documents(spark, sf_dir))
    return df.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(
        F.count("*").alias("n"), F.max(F.length("text")).cast("bigint").alias("n_chars")
    )


@query
def head_n_with_id(spark, sf_dir):
    df = sample.head_n_with_id(views.documents(spark, sf_dir), HEAD_N, "doc_id")
    return df.select("id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def write_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    jsonl.write_jsonl(_texts(views.label_gt(spark, sf_dir), spark, sf_dir).select("id", "text", "label"), path)
    df = jsonl.scan_folders(spark, [path], pattern="*.json")
    return df.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label")


@query
def append_clean_incremental(spark, sf_dir):
    preds = views.label_pred(spark, sf_dir).withColumnRenamed("system", "trait")
    root = scratch_path(spark, "append")
    args = (spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    first = F.col("id") % 3 == 0
    for part in (preds.where(first), preds.where(~first), None):
        if part is not None:
            part.write.mode("append").json(f"{root}/in")
        run_stream(*args, pattern="*.json").awaitTermination()
    df = jsonl.scan_folders(spark, [f"{root}/out"], pattern="*.json")
    return df.select(F.col("trait").alias("system"), "id", "label")


@query
def clean_with_rejects(spark, sf_dir):
    """Two rounds of new files and one without; every row is in one of two sinks."""
    preds = views.label_pred(spark, sf_dir).withColumnRenamed("system", "trait")
    root = scratch_path(spark, "rejects")
    first = F.col("id") % 3 == 0
    for part in (preds.where(first), preds.where(~first), None):
        if part is not None:
            part.write.mode("append").json(f"{root}/in", compression="gzip")
        args = [f"{root}/{f}" for f in ("in", "valid", "rejected", "checkpoint")]
        stream.clean_with_rejects(spark, *args, pattern="*.json.gz", compression="gzip").awaitTermination()
    sinks = [
        stream.scan_batches(spark, f"{root}/{f}").withColumn("kept", F.lit(f == "valid"))
        for f in ("valid", "rejected")
    ]
    return sinks[0].unionByName(sinks[1]).select(F.col("trait").alias("system"), "id", "kept", "label")


@query
def replace_one_system(spark, sf_dir):
    """Three systems are stored, then one of them again by another model."""
    docs, path = _docs(spark, sf_dir), scratch_path(spark, "systems")

    def answers(*models):
        return {s: infer.infer_many_systems(docs, {s: stubs.LengthModel(m)}) for s, m in models}

    store.replace_systems(spark, answers(("a", "a"), ("b", "b"), ("c", "c")), path)
    store.replace_systems(spark, answers(("b", "newer")), path)
    return store.read_systems(spark, path).select("system", "id", "label", "error")


@query
def write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split = _texts(_split(spark, sf_dir), spark, sf_dir).select("id", "text", "label", "split")
    jsonl.write_partitioned(split, path, "split")
    df = spark.read.schema(f"{jsonl.RECORD_SCHEMA}, split STRING").json(path)
    return df.select("id", "label", "split")


@query
def metrics_report(spark, sf_dir):
    truth = views.label_gt(spark, sf_dir).withColumn("system", F.lit("truth"))
    verdicts = _validated(spark, sf_dir).unionByName(O.validate_lenient(truth))
    verdicts = verdicts.withColumnRenamed("id", "pos")
    verdicts = materialize(verdicts.select("system", "pos", "reason", "scores"), "verdicts")
    aligned = materialize(_aligned(spark, sf_dir), "aligned")
    per_trait = materialize(metrics.trait_mse(A.compared_traits(aligned)), "traits")
    lines = O.union_sources(
        report.validity_report(verdicts, THRESHOLD),
        report.comparison_report(per_trait, A.compare_coverage(aligned)),
    )
    return lines.select(
        F.coalesce("system", F.lit("")).alias("system"),
        _long("part"),
        _long("item"),
        _long("line_no"),
        "line",
    )


# --- projections and filters -------------------------------------------------------------


@query
def project_labeled(spark, sf_dir):
    with_trait = views.label_pred(spark, sf_dir).withColumnRenamed("system", "trait")
    rows = O.project_labeled(_texts(with_trait, spark, sf_dir)).unionByName(
        O.project_labeled(_texts(views.label_gt(spark, sf_dir), spark, sf_dir))
    )
    return rows.select("id", F.length("text").cast("bigint").alias("n_text"), "label", "trait")


@query
def filter_valid_strict(spark, sf_dir):
    return O.filter_valid_strict(views.label_pred(spark, sf_dir)).select("system", "id")


@query
def validate_lenient_reason(spark, sf_dir):
    return _validated(spark, sf_dir).select("system", "id", "reason", "repaired")


@query
def clean_labels(spark, sf_dir):
    return O.clean_labels(views.label_pred(spark, sf_dir)).select("system", "id", "label")


@query
def reject_reasons(spark, sf_dir):
    df = O.reject_reasons(views.label_pred(spark, sf_dir))
    return df.select("system", "id", "reason", "label")


# --- scalar functions ---------------------------------------------------------------------


@query
def json_simple_fix(spark, sf_dir):
    df = views.label_pred(spark, sf_dir)
    return df.select("system", "id", J.simple_fix(F.col("label")).alias("fixed"))


@query
def extract_and_fix_json(spark, sf_dir):
    df = views.label_pred(spark, sf_dir)
    return df.select("system", "id", J.extract_and_fix(F.col("label")).alias("fixed"))


@query
def parse_or_repair(spark, sf_dir):
    df = O.parse_label(views.label_pred(spark, sf_dir), fix="extract")
    ok = F.col("parsed").isNotNull()
    return df.select(
        "system", "id", ok.alias("ok"), "repaired", F.when(ok, F.col("parsed_text")).alias("json")
    )


@query
def strip_code_fence(spark, sf_dir):
    answer = F.when(
        F.col("id") % 2 == 0, F.concat(F.lit(" \n```json\n"), F.col("label"), F.lit("\n```\n"))
    ).otherwise(F.col("label"))
    df = views.label_gt(spark, sf_dir)
    return df.select("id", J.strip_code_fence(answer).alias("label"))


@query
def coerce_score(spark, sf_dir):
    df = O.parse_label(views.label_pred(spark, sf_dir), fix="extract")
    names = [t.replace(" ", "_") for t in CRITERIA]
    return df.select("system", "id", *[L.score("parsed", t).alias(n) for t, n in zip(CRITERIA, names)])


@query
def score_bin(spark, sf_dir):
    df = O.traits_to_long(views.label_gt(spark, sf_dir))
    return df.select("id", "trait", L.score_bin(F.col("score"), THRESHOLD).alias("bin"))


@query
def strat_key(spark, sf_dir):
    return S.with_strat_key(views.label_pred(spark, sf_dir)).select("system", "id", "strat_key")


@query
def traits_to_long(spark, sf_dir):
    df = O.traits_to_long(views.label_pred(spark, sf_dir))
    return df.select("system", "id", "trait", _long("score"), "feedback")


@query
def word_count(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return df.select("id", TX.word_count(F.col("text")).cast("bigint").alias("words"))


def _message_columns(messages: Column) -> list[Column]:
    system, user = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    return [
        system["role"].alias("role_0"),
        F.md5(system["content"].cast("binary")).alias("content_0"),
        user["role"].alias("role_1"),
        F.md5(user["content"].cast("binary")).alias("content_1"),
    ]


@query
def judge_prompt(spark, sf_dir):
    df = _docs(spark, sf_dir)
    text = F.col("text")
    judge = P.judge_messages(text)
    system, user = (F.get(judge, F.lit(i))["content"] for i in (0, 1))
    return df.select(
        "id",
        *_message_columns(P.prompt_messages(text)),
        F.md5(system.cast("binary")).alias("judge_system"),
        F.md5(user.cast("binary")).alias("judge_user"),
    )


@query
def rewrite_prompt(spark, sf_dir):
    traits = F.array(*[F.lit(t) for t in TRAITS_TO_AUGMENT])
    df = _docs(spark, sf_dir).withColumn("trait", F.explode(traits))
    prompt = P.rewrite_prompt(F.col("trait"), F.col("text"))
    return df.select("id", "trait", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query
def completion_strip(spark, sf_dir):
    tokens = F.transform(TX.words(F.col("text")), lambda w: F.length(w))
    df = _docs(spark, sf_dir).select("id", tokens.alias("ids"))
    out = P.completion(F.col("ids"), (F.size("ids") / 3).cast("int"))
    return df.select(
        "id", F.size(out).cast("bigint").alias("n_generated"), _array_md5(out).alias("ids")
    )


# --- joins --------------------------------------------------------------------------------


@query
def align_systems_positional(spark, sf_dir):
    preds, root = views.label_pred(spark, sf_dir), scratch_path(spark, "systems")
    record = F.to_json(F.struct("id", "label")).alias("value")
    paths = {}
    for system in views.SYSTEMS:
        rows = preds.where(F.col("system") == system)
        if system == "sys1":  # lost rows shift everything behind them
            rows = rows.where(F.col("id") % 97 != 13)
        paths[system] = f"{root}/{system}"
        jsonl.write_lines_in_order(rows.select("id", record), "id", paths[system], "gzip")
    truth = f"{root}/truth"
    jsonl.write_lines_in_order(views.label_gt(spark, sf_dir).select("id", record), "id", truth, "gzip")
    records = jsonl.records_of_lines(jsonl.scan_systems(spark, paths))
    gt = jsonl.records_of_lines(jsonl.scan_lines_with_position(spark, truth))
    aligned = A.align(
        records.select("system", "pos", "label"), gt.select("pos", "label"), views.SYSTEMS, ["pos"]
    )
    return A.align_by_id(aligned).select("pos", "system", "ok", "comparable")


@query
def align_systems_by_id(spark, sf_dir):
    return A.align_by_id(_aligned(spark, sf_dir)).select("id", "system", "ok", "comparable")


@query
def valid_in_all_systems(spark, sf_dir):
    return A.valid_in_all_systems(_aligned(spark, sf_dir)).select("id", "system")


@query
def invalid_in_any_system(spark, sf_dir):
    return A.invalid_in_any_system(_aligned(spark, sf_dir)).select("id", "system")


@query
def sample_join(spark, sf_dir):
    df = sample.sample_join(_docs(spark, sf_dir), TRAITS_TO_AUGMENT, DRAWS)
    return df.select("trait", "draw", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- aggregations -------------------------------------------------------------------------


@query
def validity_rate(spark, sf_dir):
    return metrics.validity_rate(_validated(spark, sf_dir))


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        F.round("avg_score", 6).alias("avg_score"),
        _long("min_score"),
        _long("max_score"),
        _long("n_above"),
        _long("n_at_or_below"),
    )


@query
def trait_summary(spark, sf_dir):
    return _summary(metrics.trait_summary(_validated(spark, sf_dir)), "system", "trait")


@query
def trait_summary_threshold_sweep(spark, sf_dir):
    df = metrics.trait_summary_sweep(_validated(spark, sf_dir), SWEEP)
    return _summary(df, "system", "trait", _long("threshold"))


@query
def trait_mse(spark, sf_dir):
    df = metrics.trait_mse(A.compared_traits(_aligned(spark, sf_dir)))
    return df.select("system", "trait", F.round("mse", 6).alias("mse"), "n")


@query
def overall_mse(spark, sf_dir):
    df = metrics.overall_mse(metrics.trait_mse(A.compared_traits(_aligned(spark, sf_dir))))
    return df.select("system", F.round("overall_mse", 6).alias("overall_mse"))


@query
def compare_coverage(spark, sf_dir):
    return A.compare_coverage(_aligned(spark, sf_dir))


def _matched(spark, sf_dir) -> DataFrame:
    traits = A.compared_traits(_aligned(spark, sf_dir, with_feedback=True))
    return metrics.feedback_match(metrics.lexical_match(traits))


@query
def feedback_match_prf(spark, sf_dir):
    return _matched(spark, sf_dir).select(
        "system", "trait", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def feedback_match_embedding(spark, sf_dir):
    with Scratch(spark) as tables:
        preds, truth = views.label_pred(spark, sf_dir), views.label_gt(spark, sf_dir)
        aligned, texts = A.align_with_texts(preds, truth, views.SYSTEMS, tables)
        traits = A.compared_traits(aligned)
        matched = match.embedding_match(traits, stubs.letter_encoder, texts=texts, encoded=tables.clear)
    return metrics.feedback_match(matched).select(
        "system", "trait", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def overall_match_f1(spark, sf_dir):
    df = metrics.overall_match_f1(_matched(spark, sf_dir))
    return df.select("system", F.round("overall_f1", 6).alias("overall_f1"))


@query
def split_balance(spark, sf_dir):
    df = S.split_balance(_split(spark, sf_dir))
    return df.select(
        "split",
        "trait",
        "low",
        "high",
        F.round("low_pct", 6).alias("low_pct"),
        F.round("high_pct", 6).alias("high_pct"),
    )


@query
def avg_transcript_words(spark, sf_dir):
    df = metrics.avg_transcript_words(_docs(spark, sf_dir))
    return df.select(F.round("avg_words", 6).alias("avg_words"), "n")


@query
def strat_key_histogram(spark, sf_dir):
    return S.strat_key_histogram(_keyed(spark, sf_dir))


@query
def split_counts(spark, sf_dir):
    return S.split_counts(_split(spark, sf_dir))


@query
def step_row_metrics(spark, sf_dir):
    seen, before = metrics.observe_rows(views.label_pred(spark, sf_dir), "input")
    kept, after = metrics.observe_rows(
        O.clean_labels(seen), "clean", from_sys2=F.col("system") == "sys2"
    )
    kept.write.format("noop").mode("overwrite").save()
    rows = [("clean_labels", before.get["rows"], after.get["rows"], after.get["from_sys2"])]
    return spark.createDataFrame(
        rows, "step string, rows_in bigint, rows_out bigint, from_sys2 bigint"
    )


# --- limits and set operations ------------------------------------------------------------


@query
def first_k_errors(spark, sf_dir):
    df = metrics.first_k_errors(_validated(spark, sf_dir), 10, "id")
    return df.select("system", "id", "reason", _long("rank"))


@query
def union_sources(spark, sf_dir):
    web = _docs(spark, sf_dir)
    items = views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), "text", F.lit("formality").alias("trait")
    )
    df = O.union_sources(items, web)
    return df.select("id", "trait", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- splitting and sampling ---------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "strat_key", "split")


@query
def stratified_split_labels(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select("doc_id")
    rows = docs.join(views.table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.concat_ws("_", "quality", "toxic").alias("strat_key")
    )
    return S.stratified_split(rows)


@query
def stratified_split_hash(spark, sf_dir):
    return S.stratified_split_hash(_docs(spark, sf_dir)).select("id", "split")


@query
def sample_with_replacement(spark, sf_dir):
    return sample.sample_with_replacement(_docs(spark, sf_dir), TRAITS_TO_AUGMENT, DRAWS)


@query
def augment_minority(spark, sf_dir):
    df = augment.augment_minority(_docs(spark, sf_dir), AUGMENT_DRAWS, stubs.rewrite_client)
    return df.select(
        "trait", "id", "text", F.md5(F.col("original").cast("binary")).alias("original_md5"), "error"
    )


@query
def augment_until_first_error(spark, sf_dir):
    df = augment.augment_minority(_docs(spark, sf_dir), AUGMENT_DRAWS, stubs.fussy_rewrite_client)
    kept = augment.until_first_error(materialize(df, "generated"))
    return kept.select("trait", "id", "text", F.md5(F.col("original").cast("binary")).alias("original_md5"))


# --- batch inference ----------------------------------------------------------------------


@query
def judge_label_rows(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    df = infer.judge_label_rows(docs, stubs.judge_client, pause=0.0)
    return df.select("id", "label", "error", _long("attempts"))


@query
def judge_with_ledger(spark, sf_dir):
    """Half of the texts are judged first; the run over all of them asks for the others."""
    docs, path = _docs(spark, sf_dir), scratch_path(spark, "ledger")
    ledger.judge_with_ledger(docs.where("id % 2 = 0"), path, stubs.judge_client, pause=0.0)
    df = ledger.judge_with_ledger(docs, path, stubs.judge_client, pause=0.0)
    return df.select("id", "label", "error", _long("attempts"))


@query
def engine_infer(spark, sf_dir):
    df = engine.engine_infer(_docs(spark, sf_dir), stubs.LengthModel(), token_budget=4096, max_batch=16)
    return df.select("id", F.length("text").cast("bigint").alias("n_text"), "label", "error")


@query
def batch_infer(spark, sf_dir):
    df = infer.batch_infer(_docs(spark, sf_dir), stubs.LengthModel())
    return df.select("id", F.length("text").cast("bigint").alias("n_text"), "label", "error")


@query
def infer_many_systems(spark, sf_dir):
    systems = {s: stubs.LengthModel(s) for s in ("epoch1", "epoch2", "epoch3")}
    docs = _docs(spark, sf_dir)
    return infer.infer_many_systems(docs, systems).select("system", "id", "label")


# --- fine-tuning examples -----------------------------------------------------------------


@query
def sft_examples(spark, sf_dir):
    df = sft.sft_examples(_texts(views.label_gt(spark, sf_dir), spark, sf_dir))
    return df.select("id", *_message_columns(F.col("messages")), "output")


def _tokenized(spark, sf_dir) -> DataFrame:
    examples = sft.sft_examples(_texts(views.label_gt(spark, sf_dir), spark, sf_dir))
    return sft.sft_tokenize_mask(examples, stubs.word_length_tokenizer)


def _array_md5(c: str | Column) -> Column:
    return F.md5(F.array_join(c, ",").cast("binary"))


@query
def sft_tokenize_mask(spark, sf_dir):
    return _tokenized(spark, sf_dir).select(
        "id",
        _long("n_prompt"),
        _long("n_full"),
        F.size("input_ids").cast("bigint").alias("length"),
        _array_md5("input_ids").alias("input_ids"),
        _array_md5("attention_mask").alias("attention_mask"),
        _array_md5("labels").alias("labels"),
    )


@query
def sft_token_budget(spark, sf_dir):
    return sft.sft_token_budget(_tokenized(spark, sf_dir))


@query
def conversation_sft(spark, sf_dir):
    df = sft.conversation_sft(views.table(spark, sf_dir, "conversations"))
    content = F.md5(F.col("content").cast("binary")).alias("content_md5")
    return df.select("conv_id", "turn", "role", content, "target", "unanswered", "duplicate")


@query
def conversation_messages(spark, sf_dir):
    df = history.conversation_messages(views.table(spark, sf_dir, "conversations"), HISTORY_TOKENS)
    whole = F.expr("array_join(transform(messages, m -> concat(m.role, ':', m.content)), '\n')")
    return df.select(
        "conv_id", "turn", F.size("messages").cast("bigint").alias("n_messages"), "n_tokens",
        F.md5(whole.cast("binary")).alias("messages_md5"),
        F.md5(F.col("output").cast("binary")).alias("output_md5"), "answers",
    )

