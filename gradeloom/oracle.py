"""DuckDB SQL that states each query of ``catalog`` independently, for checking results.

Plain text building only; nothing here is used by the Spark jobs.
"""

from __future__ import annotations

from gradeloom.settings import CRITERIA, MAX_TOKENS, SEED, STRATIFY_BY, THRESHOLD

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SEEDS = (
    "n_chars",
    "doc_id * 7 + n_chars",
    "doc_id * 3 + 1",
    "doc_id + n_chars * 3",
    "n_chars * 13 + 2",
    "doc_id * doc_id",
)
_SYSTEMS = ("sys0", "sys1", "sys2")


# The wording that prompts must have.
_SYSTEM = (
    "You are an expert speech evaluator. Given a transcript of a speaker's message, assess the communication quality in terms of the following traits:\n"
    "    ['formality', 'persuasiveness', 'enthusiasm', 'empathy', 'filler words', 'transition logic']\n"
    '\n'
    '    For each trait, assign a score from 1 (poor) to 10 (excellent). Be honest and critical in your assessment without bias toward high scores. \n'
    '    Then provide a short explanation (1–2 sentences) justifying your score for that trait.\n'
    '\n'
    '    The final output must be a JSON string with the exact format below:\n'
    "    {'formality': {'score': '<int>', 'feedback': '<string>'}, 'persuasiveness': {'score': '<int>', 'feedback': '<string>'}, 'enthusiasm': {'score': '<int>', 'feedback': '<string>'}, 'empathy': {'score': '<int>', 'feedback': '<string>'}, 'filler words': {'score': '<int>', 'feedback': '<string>'}, 'transition logic': {'score': '<int>', 'feedback': '<string>'}}"
)
_JUDGE_SYSTEM = (
    '\n'
    "    You are an expert speech evaluator. Given a transcript of a speaker's message, assess the communication quality in terms of the following traits:\n"
    "    ['formality', 'persuasiveness', 'enthusiasm', 'empathy', 'filler words', 'transition logic']\n"
    '\n'
    '    For each trait, assign a score from 1 (poor) to 10 (excellent). Be honest and critical in your assessment without bias toward high scores. \n'
    '    Then provide a short explanation (1–2 sentences) justifying your score for that trait.\n'
    '    \n'
    '    The final output must be a JSON string with the exact format below:\n'
    "    {'formality': {'score': '<int>', 'feedback': '<string>'}, 'persuasiveness': {'score': '<int>', 'feedback': '<string>'}, 'enthusiasm': {'score': '<int>', 'feedback': '<string>'}, 'empathy': {'score': '<int>', 'feedback': '<string>'}, 'filler words': {'score': '<int>', 'feedback': '<string>'}, 'transition logic': {'score': '<int>', 'feedback': '<string>'}}\n"
    '    '
)
_PERSONAS = {
    'formality': (
        'Imitate a casual blogger who uses informal language, contractions, or slang inappropriately in a serious context, rewrite the sample in a way that **lacks formality**.'
    ),
    'persuasiveness': (
        'Imitate a passive commentator who avoids strong arguments and fails to support claims with logic or evidence, rewrite the sample in a way that **lacks persuasiveness**.'
    ),
    'transition logic': (
        'Imitate a disorganized writer who jumps between ideas without smooth transitions or coherent flow, rewrite the sample in a way that **lacks clear transition logic**.'
    ),
    'filler words': (
        'Imitate a writer who uses redundant connectors, rewrite the sample in a way that **includes filler words rarely but surely**.'
    ),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    """The text without outer white space."""
    return f"regexp_replace(regexp_replace({x}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


# --- the derived label views ---------------------------------------------------------------


def _part(trait: str, score: str, i: int, shift: int) -> str:
    start, stop = f"(length(text) * {i} // 6)", f"(length(text) * {i + 1} // 6)"
    piece = f"substr(text, {start} + {1 + shift}, {stop} - {start})"
    fb = f"trim(regexp_replace({piece}, '[^A-Za-z ]', ' ', 'g'))"
    return f"""'"{trait}": {{"score": ' || {score} || ', "feedback": "' || {fb} || '"}}'"""


def _gt() -> str:
    parts = " || ', ' || ".join(
        _part(t, f"(1 + ({m}) % 10)::VARCHAR", i, 0) for i, (t, m) in enumerate(zip(CRITERIA, _SEEDS))
    )
    return f"label_gt AS (SELECT doc_id AS id, text, n_chars, '{{' || {parts} || '}}' AS label FROM documents)"


def _pred() -> str:
    parts = []
    for i, (t, m) in enumerate(zip(CRITERIA, _SEEDS)):
        n = f"(1 + ({m} + (doc_id + {i}) % (4 - k)) % 10)::VARCHAR"
        n = {
            "formality": f"CASE WHEN c = 10 THEN 'null' ELSE {n} END",
            "persuasiveness": f"CASE WHEN c = 4 THEN '11' ELSE {n} END",
            "enthusiasm": f"""CASE WHEN c = 5 THEN '"' || {n} || '"' ELSE {n} END""",
            "empathy": f"CASE WHEN c = 6 THEN {n} || '.9' ELSE {n} END",
        }.get(t, n)
        part = _part(t, f"({n})", i, 2)
        parts.append(f"CASE WHEN c <> 3 THEN {part} END" if t == "filler words" else part)
    return f"""
damage AS (
  SELECT doc_id, text, n_chars, k, CASE WHEN k < 2 THEN (doc_id + 5 * k) % 16 ELSE 15 END AS c
  FROM documents CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS k)
),
whole AS (SELECT *, '{{' || concat_ws(', ', {", ".join(parts)}) || '}}' AS j FROM damage),
label_pred AS (
  SELECT 'sys' || k AS system, doc_id AS id, text, CASE c
    WHEN 0 THEN left(j, length(j) - 1) || ',}}'
    WHEN 1 THEN left(j, length(j) - 1)
    WHEN 2 THEN 'Here is my rating:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 7 THEN left(j, 120)
    WHEN 8 THEN 'I cannot rate this.'
    WHEN 9 THEN j || ' Hope this helps'
    ELSE j END AS label
  FROM whole
)"""


def _fix(x: str) -> str:
    opens = f"length({x}) - length(replace({x}, '{{', ''))"
    closes = f"length({x}) - length(replace({x}, '}}', ''))"
    tidy = f"regexp_replace({x}, ',\\s*([}}\\]])', '\\1', 'g')"
    return f"{tidy} || CASE WHEN {opens} > {closes} THEN '}}' ELSE '' END"


def _is_json(x: str) -> str:
    return f"(json_valid({x}) AND NOT regexp_matches({x}, ',\\s*[}}\\]]'))"


def _extract(x: str) -> str:
    fence = f"regexp_extract({x}, '```json\\s*(\\{{.*?\\}})\\s*```', 1, 's')"
    brace = f"regexp_extract({x}, '(\\{{.*\\}})', 1, 's')"
    return f"coalesce(nullif({fence}, ''), nullif({brace}, ''), trim({x}))"


def _path(trait: str, *rest: str) -> str:
    return _q("$." + ".".join(f'"{p}"' for p in (trait, *rest)))


def _kind(trait: str, *rest: str) -> str:
    return f"json_type(js, {_path(trait, *rest)})"


def _score(trait: str) -> str:
    kind, raw = _kind(trait, "score"), f"json_extract_string(js, {_path(trait, 'score')})"
    return f"""(CASE WHEN {kind} IN ('UBIGINT', 'BIGINT') THEN TRY_CAST({raw} AS BIGINT)
      WHEN {kind} = 'DOUBLE' THEN CAST(trunc(TRY_CAST({raw} AS DOUBLE)) AS BIGINT)
      WHEN {kind} = 'BOOLEAN' THEN CASE {raw} WHEN 'true' THEN 1 ELSE 0 END
      WHEN {kind} = 'VARCHAR' AND regexp_full_match({raw}, '\\s*[+-]?\\d+\\s*')
        THEN TRY_CAST(trim({raw}) AS BIGINT) END)"""


def _reason() -> str:
    arms = ["WHEN js IS NULL THEN 'Unrecoverable JSON decode error'"]
    for t in CRITERIA:
        arms += [
            f"WHEN {_kind(t)} IS NULL THEN 'Missing field: {t}'",
            f"WHEN {_kind(t)} <> 'OBJECT' THEN 'Field ''{t}'' is not a dict'",
            f"WHEN {_kind(t, 'score')} IS NULL OR {_kind(t, 'feedback')} IS NULL "
            f"THEN 'Field ''{t}'' missing ''score'' or ''feedback'''",
            f"WHEN {_score(t)} IS NULL THEN 'Score in ''{t}'' is not int'",
            f"WHEN {_score(t)} NOT BETWEEN 1 AND 10 THEN 'Score in ''{t}'' outside range'",
            f"WHEN {_kind(t, 'feedback')} <> 'VARCHAR' THEN 'Feedback in ''{t}'' is not str'",
        ]
    return "CASE " + "\n".join(arms) + " END"


def _strict() -> str:
    return " AND ".join(
        f"{_kind(t, 'score')} IN ('UBIGINT', 'BIGINT', 'BOOLEAN') AND {_score(t)} BETWEEN 1 AND 10 "
        f"AND {_kind(t, 'feedback')} = 'VARCHAR'"
        for t in CRITERIA
    )


_LENIENT = f"""
fixed AS (SELECT *, {_fix(_extract("label"))} AS fx FROM label_pred),
chosen AS (
  SELECT *, CASE WHEN {_is_json("label")} THEN label WHEN {_is_json("fx")} THEN fx END AS js,
    NOT {_is_json("label")} AND {_is_json("fx")} AS repaired
  FROM fixed
),
lenient AS (SELECT *, {_reason()} AS reason FROM chosen)"""

_STRICT = f"""
simple AS (SELECT *, {_fix("label")} AS fx FROM label_pred),
chosen AS (
  SELECT *, CASE WHEN {_is_json("label")} THEN label WHEN {_is_json("fx")} THEN fx END AS js
  FROM simple
),
clean AS (SELECT system, id, js AS label FROM chosen WHERE js IS NOT NULL AND {_strict()})"""


def _long(source: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{t}' AS trait, {_score(t)}::BIGINT AS score, "
        f"json_extract_string(js, {_path(t, 'feedback')}) AS feedback FROM {source}"
        for t in CRITERIA
    )


_LONG = f"long AS ({_long('(SELECT * FROM lenient WHERE reason IS NULL)', 'system, id')})"
_GT_LONG = f"gt_long AS ({_long('(SELECT id, label AS js FROM label_gt)', 'id')})"

_ALIGN = """
per_id AS (SELECT id, count(*) AS present, count(*) FILTER (reason IS NULL) AS good FROM lenient GROUP BY id),
aligned AS (
  SELECT l.id, l.system, l.reason IS NULL AS ok, p.good = 3 AS comparable
  FROM lenient l JOIN per_id p USING (id) JOIN label_gt g USING (id) WHERE p.present = 3
)"""
_PAIRS = """
pairs AS (
  SELECT l.system, l.trait, l.id, l.score, g.score AS gt_score, l.feedback, g.feedback AS gt_feedback
  FROM long l JOIN aligned a ON l.id = a.id AND l.system = a.system AND a.comparable
  JOIN gt_long g ON l.id = g.id AND l.trait = g.trait
),
mse AS (SELECT system, trait, avg((score - gt_score) * (score - gt_score)) AS mse, count(*) AS n FROM pairs GROUP BY ALL)"""


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[^{_WS}]+')"


_MATCH = f"""
tok AS (SELECT system, trait, {_tokens("feedback")} AS p, {_tokens("gt_feedback")} AS r FROM pairs),
pr AS (
  SELECT system, trait,
    CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: list_contains(r, x))) / len(p) ELSE 0 END AS precision,
    CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: list_contains(p, x))) / len(r) ELSE 0 END AS recall
  FROM tok
),
prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM pr
),
matched AS (
  SELECT system, trait, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM prf GROUP BY ALL
)"""


def _mean_best(own: str, other: str) -> str:
    """Mean over the words of ``own`` of the best cosine with a word of ``other``; words are
    given as counts per first character."""
    vec = "[1.0, ({0} % 5)::DOUBLE, ({0} % 7)::DOUBLE]"
    best = (
        f"list_max(list_transform(map_keys({other}), lambda y: "
        f"list_cosine_similarity({vec.format('x')}, {vec.format('y')})))"
    )
    total = f"list_sum(list_transform(map_keys({own}), lambda x: {own}[x] * {best}))"
    return (
        f"CASE WHEN cardinality({own}) > 0 AND cardinality({other}) > 0 "
        f"THEN {total} / list_sum(map_values({own})) ELSE 0 END"
    )


def _firsts(x: str) -> str:
    return f"list_histogram(list_transform({_tokens(x)}, lambda w: unicode(w)))"


_EMBEDDING = f"""
firsts AS (SELECT system, trait, {_firsts("feedback")} AS a, {_firsts("gt_feedback")} AS b FROM pairs),
best AS (SELECT system, trait, {_mean_best("a", "b")} AS p, {_mean_best("b", "a")} AS r FROM firsts)"""


def _summary(thresholds) -> str:
    levels = ", ".join(map(str, thresholds))
    return f"""SELECT system, trait, t AS threshold, round(avg(score), 6) AS avg_score, min(score) AS min_score,
      max(score) AS max_score, count(*) FILTER (score > t) AS n_above,
      count(*) FILTER (score <= t) AS n_at_or_below
    FROM long CROSS JOIN (SELECT unnest([{levels}])::BIGINT AS t) GROUP BY ALL"""


# --- splitting -----------------------------------------------------------------------------


def _bin(trait: str) -> str:
    return f"CASE WHEN {_score(trait)} > {THRESHOLD} THEN 'high' ELSE 'low' END"


_KEYED = f"""
keyed AS (
  SELECT id, concat_ws('_', {", ".join(_bin(t) for t in STRATIFY_BY)}) AS strat_key
  FROM (SELECT id, label AS js FROM label_gt)
)"""

_TEST_SHARE = 1 - 0.1 / (1 - 0.8)


def _quota(source: str, count: str, seats: str, total: str, out: str) -> str:
    return f"""
{out}_share AS (
  SELECT *, CASE WHEN {total} > 0 THEN ({count}::HUGEINT * {seats}) // {total} ELSE 0 END AS fl,
    CASE WHEN {total} > 0 THEN ({count}::HUGEINT * {seats}) % {total} ELSE 0 END AS rest FROM {source}
),
{out}_seats AS (
  SELECT * EXCLUDE (fl, rest), (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, strat_key)
    <= {seats} - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS {out} FROM {out}_share
)"""


_SPLIT = f"""
strata AS (SELECT strat_key, count(*) AS n FROM keyed GROUP BY 1),
sized AS (
  SELECT *, sum(n) OVER () AS total, sum((n = 1)::INT) OVER () AS singles,
    CASE WHEN n = 1 THEN 0 ELSE n END AS m FROM strata
),
pools AS (
  SELECT *, total - singles AS pool, least(ceil(total * {1 - 0.8!r}::DOUBLE), total - singles)::BIGINT AS held FROM sized
),
seats AS (SELECT *, pool - held AS train_seats FROM pools),
{_quota("seats", "m", "train_seats", "pool", "train_n")},
rests AS (
  SELECT *, m - train_n AS rest_n, held - ceil(held * {_TEST_SHARE!r}::DOUBLE)::BIGINT AS val_seats FROM train_n_seats
),
{_quota("rests", "rest_n", "val_seats", "held", "val_n")},
split AS (
  SELECT id, strat_key, CASE WHEN rn <= rest_n - val_n THEN 'test' WHEN rn <= rest_n THEN 'val' ELSE 'train' END AS split
  FROM (
    SELECT id, strat_key, row_number() OVER (PARTITION BY strat_key ORDER BY md5(id || '|{SEED}')) AS rn FROM keyed
  ) JOIN val_n_seats USING (strat_key)
)"""


def _hex(x: str, digits: int) -> str:
    return f"('0x' || left(md5({x}), {digits}))::BIGINT"


def _draws(n: int) -> str:
    traits = ", ".join(_q(t) for t in _PERSONAS)
    return f"""
ranked AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY md5(doc_id || '|{SEED}'), doc_id) - 1 AS pos FROM documents),
draws AS (
  SELECT trait, draw, {_hex(f"trait || '|' || draw || '|{SEED}'", 15)} % (SELECT count(*) FROM documents) AS pos
  FROM (SELECT unnest([{traits}]) AS trait) CROSS JOIN (SELECT unnest(range(1, {n} + 1)) AS draw)
),
drawn AS (SELECT trait, draw, id, text FROM draws JOIN ranked USING (pos))"""


# --- prompts -------------------------------------------------------------------------------


def _rewrite(trait: str, text: str) -> str:
    arms = []
    for name, persona in _PERSONAS.items():
        pad, blank = " " * 16, " " if name == "transition logic" else ""
        lines = [
            "You are given a reference article-style sample.",
            blank,
            pad + persona,
            "",
            pad + "Only output the transcript content.",
            "",
            pad + "### Reference Sample:",
            pad,
        ]
        arms.append(f"WHEN {_q(name)} THEN {_q(chr(10).join(lines))}")
    return _strip(f"(CASE {trait} {' '.join(arms)} END || {_strip(text)})")


_CHAT_HEAD = f"<|im_start|>system\n{_SYSTEM}<|im_end|>\n<|im_start|>user\nTranscript:\n"
_CHAT_TAIL = "<|im_end|>\n<|im_start|>assistant\n"
_CHAT = f"{_q(_CHAT_HEAD)} || text || {_q(_CHAT_TAIL)}"
_TOKENIZED = f"""
chat AS (SELECT id, {_CHAT} AS prompt, label FROM label_gt),
toks AS (
  SELECT id, list_transform(regexp_extract_all(prompt, '[^{_WS}]+'), lambda w: length(w)) AS p,
    list_transform(regexp_extract_all(prompt || label, '[^{_WS}]+'), lambda w: length(w)) AS f
  FROM chat
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def statements(
    head_n: int, draws: int, augment_draws: int, sweep, history_tokens: int = 200
) -> dict[str, str]:
    gt, pred = _gt(), _pred()
    lenient = _with(pred, _LENIENT)
    long = _with(pred, _LENIENT, _LONG)
    compare = _with(gt, pred, _LENIENT, _LONG, _GT_LONG, _ALIGN, _PAIRS)
    split = _with(gt, _KEYED, _SPLIT)
    docs = "(SELECT doc_id AS id, text FROM documents)"
    line = "CASE WHEN id % 16 IN (3, 5) THEN 'Outer JSON error' END"
    sql = {
        "scan_jsonl_folder": _with(pred) + "SELECT id, md5(text) AS text_md5, label, system AS trait FROM label_pred",
        "scan_jsonl_skip_blank": f"SELECT id, md5(text) AS text_md5 FROM {docs}",
        "scan_lines_with_position": _with(gt)
        + f"""SELECT row_number() OVER (ORDER BY id) - 1 AS pos, CASE WHEN {line} IS NULL THEN id END AS id,
          CASE WHEN {line} IS NULL THEN label END AS label, {line} AS reason FROM label_gt""",
        "scan_lines_by_index": _with(gt)
        + f"""SELECT row_number() OVER (ORDER BY id) - 1 AS pos, CASE WHEN {line} IS NULL THEN id END AS id,
          CASE WHEN {line} IS NULL THEN label END AS label, {line} AS reason FROM label_gt""",
        "scan_column_stripped": f"""SELECT md5(s) AS text_md5, count(*) AS n, max(length(s)) AS n_chars
          FROM (SELECT {_strip("text")} AS s FROM documents) GROUP BY 1""",
        "head_n_with_id": f"""SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, md5(text) AS text_md5
          FROM documents ORDER BY doc_id LIMIT {head_n}""",
        "write_jsonl": _with(gt) + "SELECT id, md5(text) AS text_md5, label FROM label_gt",
        "append_clean_incremental": _with(pred, _STRICT) + "SELECT system, id, label FROM clean",
        "write_splits": split + "SELECT id, label, split FROM split JOIN label_gt USING (id)",
        "project_labeled": _with(gt, pred)
        + """SELECT id, length(text) AS n_text, label, system AS trait FROM label_pred
          UNION ALL SELECT id, length(text), label, NULL FROM label_gt""",
        "filter_valid_strict": _with(pred)
        + f"""SELECT system, id FROM (SELECT *, CASE WHEN {_is_json("label")} THEN label END AS js FROM label_pred)
          WHERE js IS NOT NULL AND {_strict()}""",
        "validate_lenient_reason": lenient + "SELECT system, id, reason, repaired FROM lenient",
        "clean_labels": _with(pred, _STRICT) + "SELECT system, id, label FROM clean",
        "reject_reasons": lenient + "SELECT system, id, reason, label FROM lenient WHERE reason IS NOT NULL",
        "json_simple_fix": _with(pred) + f"SELECT system, id, {_fix('label')} AS fixed FROM label_pred",
        "extract_and_fix_json": _with(pred)
        + f"SELECT system, id, {_fix('e')} AS fixed FROM (SELECT *, {_extract('label')} AS e FROM label_pred)",
        "parse_or_repair": lenient + "SELECT system, id, js IS NOT NULL AS ok, repaired, js AS json FROM lenient",
        "strip_code_fence": _with(gt) + "SELECT id, label FROM label_gt",
        "coerce_score": lenient
        + f"SELECT system, id, {', '.join(f'{_score(t)}::BIGINT AS ' + t.replace(' ', '_') for t in CRITERIA)} FROM lenient",
        "score_bin": _with(gt, _GT_LONG)
        + f"SELECT id, trait, CASE WHEN score > {THRESHOLD} THEN 'high' ELSE 'low' END AS bin FROM gt_long",
        "strat_key": _with(pred)
        + f"""SELECT system, id, CASE WHEN js IS NULL OR {" OR ".join(
            f"({_kind(t)} IS NOT NULL AND coalesce({_kind(t, 'score')}, 'NULL') IN ('NULL', 'VARCHAR', 'OBJECT', 'ARRAY'))"
            for t in STRATIFY_BY)} THEN 'unknown' ELSE concat_ws('_', {", ".join(
            f"CASE WHEN {_kind(t)} IS NOT NULL THEN CASE WHEN TRY_CAST(json_extract_string(js, {_path(t, 'score')}) AS DOUBLE) > {THRESHOLD} THEN 'high' ELSE 'low' END END"
            for t in STRATIFY_BY)}) END AS strat_key
          FROM (SELECT *, CASE WHEN {_is_json("label")} THEN label END AS js FROM label_pred)""",
        "traits_to_long": long + "SELECT system, id, trait, score, feedback FROM long",
        "word_count": f"SELECT id, len(regexp_extract_all(text, '[^{_WS}]+'))::BIGINT AS words FROM {docs}",
        "judge_prompt": f"""SELECT id, 'system' AS role_0, md5({_q(_SYSTEM)}) AS content_0, 'user' AS role_1,
          md5('Transcript:' || chr(10) || text) AS content_1, md5({_q(_JUDGE_SYSTEM)}) AS judge_system,
          md5(chr(10) || '    Transcript:' || chr(10) || '    ' || text || chr(10) || '    ') AS judge_user FROM {docs}""",
        "rewrite_prompt": f"""SELECT id, trait, md5({_rewrite("trait", "text")}) AS prompt_md5
          FROM {docs} CROSS JOIN (SELECT unnest([{", ".join(_q(t) for t in _PERSONAS)}]) AS trait)""",
        "completion_strip": f"""SELECT id, len(g)::BIGINT AS n_generated, md5(array_to_string(g, ',')) AS ids FROM (
          SELECT id, ids[len(ids) // 3 + 1 :] AS g FROM (
            SELECT id, list_transform({_tokens("text")}, lambda w: length(w)) AS ids FROM {docs}))""",
        "align_systems_positional": _with(gt, pred, _LENIENT)
        + """, numbered AS (
            SELECT system, reason IS NULL AS ok, row_number() OVER (PARTITION BY system ORDER BY id) - 1 AS pos
            FROM lenient WHERE NOT (system = 'sys1' AND id % 97 = 13)
          ), counted AS (SELECT *, count(*) OVER (PARTITION BY pos) AS present,
            count(*) FILTER (ok) OVER (PARTITION BY pos) AS good FROM numbered)
          SELECT pos, system, ok, good = 3 AS comparable FROM counted WHERE present = 3""",
        "align_systems_by_id": _with(gt, pred, _LENIENT, _ALIGN) + "SELECT id, system, ok, comparable FROM aligned",
        "valid_in_all_systems": _with(gt, pred, _LENIENT, _ALIGN) + "SELECT id, system FROM aligned WHERE comparable",
        "invalid_in_any_system": _with(gt, pred, _LENIENT, _ALIGN)
        + "SELECT id, system FROM aligned WHERE NOT comparable",
        "sample_join": _with(_draws(draws)) + "SELECT trait, draw, id, md5(text) AS text_md5 FROM drawn",
        "validity_rate": lenient
        + """SELECT system, count(*) FILTER (reason IS NULL) AS valid, count(*) AS total,
          count(*) FILTER (reason IS NOT NULL) AS invalid FROM lenient GROUP BY system""",
        "trait_summary": long + f"SELECT * EXCLUDE (threshold) FROM ({_summary([THRESHOLD])})",
        "trait_summary_threshold_sweep": long + _summary(sweep),
        "trait_mse": compare + "SELECT system, trait, round(mse, 6) AS mse, n FROM mse",
        "overall_mse": compare + "SELECT system, round(avg(mse), 6) AS overall_mse FROM mse GROUP BY system",
        "compare_coverage": _with(gt, pred, _LENIENT, _ALIGN)
        + "SELECT count(DISTINCT id) FILTER (comparable) AS compared, count(DISTINCT id) AS total FROM aligned",
        "feedback_match_prf": compare.rstrip()
        + ","
        + _MATCH
        + """ SELECT system, trait, round(precision, 6) AS precision, round(recall, 6) AS recall,
          round(f1, 6) AS f1 FROM matched""",
        "overall_match_f1": compare.rstrip()
        + ","
        + _MATCH
        + " SELECT system, round(avg(f1), 6) AS overall_f1 FROM matched GROUP BY system",
        "split_balance": _with(gt, _KEYED, _SPLIT, _GT_LONG)
        + f"""SELECT split, trait, low, high, round(low * 100 / (low + high), 6) AS low_pct,
            round(high * 100 / (low + high), 6) AS high_pct
          FROM (SELECT split, trait, count(*) FILTER (score <= {THRESHOLD}) AS low,
              count(*) FILTER (score > {THRESHOLD}) AS high
            FROM split JOIN gt_long USING (id) WHERE trait IN ({", ".join(_q(t) for t in STRATIFY_BY)}) GROUP BY ALL)""",
        "avg_transcript_words": f"""SELECT round(avg(len(regexp_extract_all(text, '[^{_WS}]+'))), 6) AS avg_words,
          count(*) AS n FROM documents""",
        "strat_key_histogram": _with(gt, _KEYED) + "SELECT strat_key, count(*) AS n FROM keyed GROUP BY 1",
        "split_counts": split + "SELECT split, count(*) AS n FROM split GROUP BY 1",
        "step_row_metrics": _with(pred, _STRICT)
        + """SELECT 'clean_labels' AS step, (SELECT count(*) FROM label_pred) AS rows_in, count(*) AS rows_out,
          count(*) FILTER (system = 'sys2') AS from_sys2 FROM clean""",
        "first_k_errors": lenient
        + """SELECT system, id, reason, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY system ORDER BY id) AS rank FROM lenient WHERE reason IS NOT NULL)
          WHERE rank <= 10""",
        "union_sources": """SELECT item_id AS id, 'formality' AS trait, md5(text) AS text_md5 FROM benchmark
          UNION ALL SELECT doc_id, NULL, md5(text) FROM documents""",
        "stratified_split": split + "SELECT id, strat_key, split FROM split",
        "stratified_split_labels": "WITH keyed AS (SELECT doc_id AS id, concat_ws('_', quality, toxic) AS strat_key "
        "FROM documents JOIN labels USING (doc_id))," + _SPLIT + " SELECT id, strat_key, split FROM split",
        "stratified_split_hash": f"""SELECT id, CASE WHEN u < {int(round((1 - 0.8 - 0.1) * 16**8))} THEN 'test'
            WHEN u < {int(round((1 - 0.8) * 16**8))} THEN 'val' ELSE 'train' END AS split
          FROM (SELECT id, {_hex(f"id || '|{SEED}'", 8)} AS u FROM {docs})""",
        "sample_with_replacement": _with(_draws(draws)) + "SELECT trait, draw, id FROM drawn",
        "augment_minority": _with(_draws(augment_draws))
        + f"""SELECT trait, draw AS id, 'rewritten from ' || length({_rewrite("trait", "text")}) || ' characters' AS text,
          md5({_strip("text")}) AS original_md5, NULL::VARCHAR AS error FROM drawn""",
        "augment_until_first_error": _with(_draws(augment_draws))
        + f""", asked AS (SELECT trait, draw, {_rewrite("trait", "text")} AS prompt, {_strip("text")} AS original FROM drawn),
          first AS (SELECT trait, min(draw) AS stop FROM asked WHERE length(prompt) % 13 = 0 GROUP BY 1)
          SELECT trait, draw AS id, 'rewritten from ' || length(prompt) || ' characters' AS text, md5(original) AS original_md5
          FROM asked LEFT JOIN first USING (trait) WHERE stop IS NULL OR draw < stop""",
        "judge_label_rows": f"""SELECT id, CASE WHEN n % 7 <> 0 THEN '{{"n": ' || (1 + n % 10) || '}}' END AS label,
          CASE WHEN n % 7 = 0 THEN 'ValueError: refused' END AS error, CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts
          FROM (SELECT id, length(text) + {len(chr(10) + "    Transcript:" + chr(10) + "    " + chr(10) + "    ")} AS n FROM {docs})""",
        "batch_infer": f"""SELECT id, length(text) AS n_text, 'base: ' || (length(text) + {len(_CHAT_HEAD + _CHAT_TAIL)}) AS label,
          NULL::VARCHAR AS error FROM {docs}""",
        "judge_with_ledger": f"""SELECT id, CASE WHEN n % 7 <> 0 THEN '{{"n": ' || (1 + n % 10) || '}}' END AS label,
          CASE WHEN n % 7 = 0 THEN 'ValueError: refused' END AS error, CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts
          FROM (SELECT id, length(text) + {len(chr(10) + "    Transcript:" + chr(10) + "    " + chr(10) + "    ")} AS n FROM {docs})""",
        "clean_with_rejects": _with(pred, _STRICT)
        + """SELECT system, id, c.id IS NOT NULL AS kept, coalesce(c.label, p.label) AS label
          FROM label_pred p LEFT JOIN clean c USING (system, id)""",
        "replace_one_system": f"""SELECT system, id, CASE WHEN system = 'b' THEN 'newer' ELSE system END || ': '
            || (length(text) + {len(_CHAT_HEAD + _CHAT_TAIL)}) AS label, NULL::VARCHAR AS error
          FROM {docs} CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS system)""",
        "engine_infer": f"""SELECT id, length(text) AS n_text, 'base: ' || (length(text) + {len(_CHAT_HEAD + _CHAT_TAIL)}) AS label,
          NULL::VARCHAR AS error FROM {docs}""",
        "infer_many_systems": f"""SELECT system, id, system || ': ' || (length(text) + {len(_CHAT_HEAD + _CHAT_TAIL)}) AS label
          FROM {docs} CROSS JOIN (SELECT unnest(['epoch1', 'epoch2', 'epoch3']) AS system)""",
        "sft_examples": _with(gt)
        + f"""SELECT id, 'system' AS role_0, md5({_q(_SYSTEM)}) AS content_0, 'user' AS role_1,
          md5('Transcript:' || chr(10) || text) AS content_1, label AS output FROM label_gt""",
        "sft_tokenize_mask": _with(gt, _TOKENIZED)
        + f""", padded AS (
            SELECT id, len(p) AS np, len(f) AS nf, least(len(p), {MAX_TOKENS}) AS cut, least(len(f), {MAX_TOKENS}) AS used,
              list_resize(f[:{MAX_TOKENS}], {MAX_TOKENS}, 0) AS ids FROM toks)
          SELECT id, np::BIGINT AS n_prompt, nf::BIGINT AS n_full, len(ids)::BIGINT AS length,
            md5(array_to_string(ids, ',')) AS input_ids,
            md5(array_to_string(list_transform(range({MAX_TOKENS}), lambda i: CASE WHEN i < used THEN 1 ELSE 0 END), ',')) AS attention_mask,
            md5(array_to_string(list_transform(range({MAX_TOKENS}), lambda i: CASE WHEN i < cut THEN -100 ELSE ids[i + 1] END), ',')) AS labels
          FROM padded""",
        "sft_token_budget": _with(gt, _TOKENIZED)
        + f"""SELECT count(*) AS n, 0 AS n_without_output, count(*) FILTER (len(f) > {MAX_TOKENS}) AS n_truncated,
          count(*) FILTER (len(p) >= {MAX_TOKENS}) AS n_fully_masked,
          sum(least(len(f), {MAX_TOKENS}))::BIGINT AS tokens_kept, sum(len(f))::BIGINT AS tokens_total FROM toks""",
        "conversation_sft": """SELECT conv_id, turn, role, md5(text) AS content_md5,
            role = 'assistant' AND EXISTS (SELECT 1 FROM conversations b
              WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role = 'user') AS target,
            role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b
              WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant') AS unanswered,
            count(*) OVER (PARTITION BY conv_id, turn) > 1 AS duplicate
          FROM conversations a""",
        "conversation_messages": f"""WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content,
              len(regexp_extract_all(coalesce(text, ''), '[^{_WS}]+')) + 4 AS cost FROM conversations
          ), p AS (
            SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
              md5(length(role) || ':' || role || content)) - cost AS start FROM t
          ), j AS (
            SELECT a.conv_id, a.turn, a.start, a.content AS output, b.start AS bs, b.role, b.content, b.cost,
              b.start >= a.start - {history_tokens} AS fits
            FROM p a LEFT JOIN p b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.start < a.start
            WHERE a.role = 'assistant'
          )
          SELECT conv_id, turn, count(bs) FILTER (fits) AS n_messages, coalesce(sum(cost) FILTER (fits), 0)::BIGINT AS n_tokens,
            md5(coalesce(string_agg(role || ':' || content, chr(10) ORDER BY bs) FILTER (fits), '')) AS messages_md5,
            md5(output) AS output_md5, coalesce(arg_max(role, bs) FILTER (fits) = 'user', false) AS answers
          FROM j GROUP BY conv_id, turn, start, output""",
        "scan_unread_keys": split
        + """SELECT id, md5(documents.text) AS text_md5, label, split, lang, source, documents.n_chars,
            CASE WHEN id % 3 = 0 THEN id END AS note FROM split JOIN label_gt USING (id) JOIN documents ON id = doc_id""",
        "feedback_match_embedding": compare.rstrip()
        + ","
        + _EMBEDDING
        + """ SELECT system, trait, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
          round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM best GROUP BY ALL""",
        "metrics_report": compare + _report(),
    }
    return sql


def _report() -> str:
    # The wording and the blank lines that the report must have.
    order = "[" + ", ".join(_q(t) for t in CRITERIA) + "]"

    def row(system, part, item, no, text, source, where=""):
        return (
            f"SELECT {system} AS system, {part}::BIGINT AS part, ({item})::BIGINT AS item, {no}::BIGINT AS line_no, "
            f"{text} AS line FROM {source} {where}"
        )

    rate = """(SELECT system, count(*) AS total, count(*) FILTER (reason IS NULL) AS valid FROM lenient GROUP BY 1
      UNION ALL SELECT 'truth', count(*), count(*) FROM label_gt)"""
    scores = "(SELECT system, trait, score FROM long UNION ALL SELECT 'truth', trait, score FROM gt_long)"
    summary = f"({_summary([THRESHOLD]).replace('FROM long', f'FROM {scores}')})"
    at = f"list_position({order}, trait)"
    errors = """(SELECT *, row_number() OVER (PARTITION BY system ORDER BY id) AS rank FROM lenient WHERE reason IS NOT NULL)"""
    parts = [
        row("system", 0, 0, -1, "''", rate),
        row("system", 0, 0, 0, f"system || ' check with score threshold {THRESHOLD}:'", rate),
        row("system", 0, 0, 1, "'Valid samples: ' || valid || '/' || total", rate),
        row("system", 0, 0, 2, "'Invalid samples: ' || (total - valid)", rate),
        row("system", 0, 0, 3, "''", rate),
        row("system", 0, 0, 4, "'Sample errors (up to 10 shown):'", rate),
        row("system", 1, "rank", 0, "'  Line ' || (id + 1) || ': ' || reason", errors, "WHERE rank <= 10"),
        row("system", 2, 0, 0, "''", rate),
        row("system", 2, 0, 1, "'Scoring summary:'", rate),
        row("system", 3, at, 0, "''", summary),
        row("system", 3, at, 1, "'Trait: ' || trait", summary),
        row("system", 3, at, 2, "'  Avg Score: ' || format('{:.2f}', avg_raw)", f"(SELECT system, trait, avg(score) AS avg_raw FROM {scores} GROUP BY ALL)"),
        row("system", 3, at, 3, f"'  >{THRESHOLD}: ' || n_above || ' | <={THRESHOLD}: ' || n_at_or_below", summary),
        row("system", 3, at, 4, "'  Min: ' || min_score || ', Max: ' || max_score", summary),
        row("system", 3, len(CRITERIA) + 1, 0, "''", rate),
        row("system", 3, len(CRITERIA) + 1, 1, "''", rate),
        row("''", 4, -1, 0, "''", "(SELECT 1)"),
        row("''", 4, -1, 1, "'MSE Metrics across generated files:'", "(SELECT 1)"),
        row("''", 4, -1, 2, "''", "(SELECT 1)"),
        row("system", 4, len(CRITERIA) + 2, 0, "''", "(SELECT DISTINCT system FROM mse)"),
        row("system", 4, 0, 0, "'Generated File: ' || system", "(SELECT DISTINCT system FROM mse)"),
        row("system", 4, at, 0, "'  ' || trait || ': ' || format('{:.4f}', mse)", "mse"),
        row("system", 4, len(CRITERIA) + 1, 0, "'  overall_avg_mse: ' || format('{:.4f}', o)", "(SELECT system, avg(mse) AS o FROM mse GROUP BY 1)"),
        row("''", 5, 0, 0, "'Compared ' || c || '/' || t || ' lines successfully (only counting lines valid in all files).'",
            "(SELECT count(DISTINCT id) FILTER (comparable) AS c, count(DISTINCT id) AS t FROM aligned)"),
    ]
    return "\nUNION ALL ".join(parts)
