"""DuckDB twins of the registered queries (the correctness gate).

Each statement starts from the same fixture views as the Spark query (defined here as CTEs over
the pre-registered tables) and computes the result from the definition, independently of the
Spark operators.  Column names and integer widths match the Spark side.
"""

from __future__ import annotations

from paraspark.constants import (
    BASELINE_SYSTEM_PROMPT, DEFAULT_SEED, DEFAULT_TASK_PREFIX, NO_METRICS_NOTE,
    SIMPLE_SYSTEM_PROMPTS, SYSTEM_PROMPTS,
)
from paraspark.functions.text import WS_RE2
from paraspark.plans import catalog as Q

SEED = DEFAULT_SEED
N_CAL = Q.SAMPLE_SIZE
REQ = ("english_scenario", "spanish_translation", "style", "target_length", "term")  # sorted
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def permutation_sql(rows: str, keys: str, seed: int) -> str:
    """CTEs that end in ``permuted``: ``rows`` with the place of their number, in order of ``keys``, as ``position``."""
    def draw(k, side):
        return h(seed, f"'{k}:' || CAST({side} AS VARCHAR)")
    net = "SELECT *, x % a AS l0, x // a AS r0 FROM walk WHERE step = 0 OR x >= n"
    for k in range(4):
        moved = (f"(l{k} + {draw(k, f'r{k}')}) % a AS l{k + 1}, r{k} AS r{k + 1}" if k % 2 == 0
                 else f"l{k} AS l{k + 1}, (r{k} + {draw(k, f'l{k}')}) % b AS r{k + 1}")
        net = f"SELECT *, {moved} FROM ({net})"
    return f"""numbered AS (SELECT {keys}, row_number() OVER (ORDER BY {keys}) - 1 AS x, count(*) OVER () AS n FROM {rows}),
sides AS (SELECT *, greatest(CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT), 1) AS a FROM numbered),
walk AS (SELECT {keys}, x, n, a, (n + a - 1) // a AS b, 0 AS step FROM sides
         UNION ALL SELECT {keys}, r4 * a + l4, n, a, b, step + 1 FROM ({net})),
permuted AS (SELECT {keys}, CAST(x AS BIGINT) AS position FROM walk WHERE step > 0 AND x < n)"""


def h(seed: int, key_sql: str) -> str:
    return f"CAST('0x' || substr(md5('{int(seed)}:' || CAST({key_sql} AS VARCHAR)), 1, 8) AS BIGINT)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS_RE2}+', ' ', 'g')"


def norm(x: str) -> str:
    return collapse(strip(f"lower({x})"))


def flat(x: str) -> str:
    return collapse(strip(x))


def clean(x: str) -> str:
    return strip(f"regexp_replace({x}, '(?s)(<\\|im_end\\|>|<\\|endoftext\\|>|<\\|im_start\\|>).*$', '')")


def ntok(x: str) -> str:
    s = flat(x)
    return f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END AS BIGINT)"


def missing(c: str) -> str:
    return f"({c} IS NULL OR CAST({c} AS VARCHAR) = '')"


VALID = " AND ".join(f"NOT {missing(c)}" for c in REQ)


def bucket(n: str) -> str:
    return (f"CASE WHEN {n} <= 512 THEN '0_512' WHEN {n} <= 1024 THEN '512_1k' WHEN {n} <= 2048 THEN '1k_2k' "
            f"WHEN {n} <= 4096 THEN '2k_4k' WHEN {n} <= 6144 THEN '4k_6k' WHEN {n} <= 8192 THEN '6k_8k' "
            f"ELSE '8k_plus' END")


def src_lang(d: str) -> str:
    return f"CASE {d} WHEN 'en-es' THEN 'English' WHEN 'es-en' THEN 'Spanish' END"


def tgt_lang(d: str) -> str:
    return f"CASE {d} WHEN 'en-es' THEN 'Spanish' WHEN 'es-en' THEN 'English' END"


def structured(d, style, tl, text) -> str:
    return (f"concat('Direction: ', {src_lang(d)}, ' to ', {tgt_lang(d)}, {NL}, 'Style: ', coalesce({style}, ''), {NL}, "
            f"'Target length: about ', coalesce({tl}, ''), ' words', {NL}, {src_lang(d)}, ': ', coalesce({text}, ''))")


def sys_prompt(d: str) -> str:
    return f"CASE {d} WHEN 'en-es' THEN {lit(SYSTEM_PROMPTS['en-es'])} WHEN 'es-en' THEN {lit(SYSTEM_PROMPTS['es-en'])} END"


def simple_prompt(d: str) -> str:
    return (f"CASE {d} WHEN 'en-es' THEN {lit(SIMPLE_SYSTEM_PROMPTS['en-es'])} "
            f"WHEN 'es-en' THEN {lit(SIMPLE_SYSTEM_PROMPTS['es-en'])} END")


# ------------------------------------------------------------------ fixture views

FX = {
    "fx_pairs": """fx_pairs AS (
  SELECT a.doc_id AS pair_id, a.source AS term,
    CAST(length(a.text) - length(replace(a.text, ' ', '')) + 1 AS VARCHAR) AS target_length,
    CASE l.quality WHEN 1 THEN 'formal' WHEN 0 THEN 'brief' ELSE '' END AS style,
    a.text AS english_scenario,
    CASE WHEN l.toxic = 1 THEN NULL ELSE b.text END AS spanish_translation
  FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1
  LEFT JOIN labels l ON l.doc_id = a.doc_id)""",
    "fx_turns": """fx_turns AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'user' AND conv_id % 9 = 2 THEN concat('Spanish: ', text)
         WHEN role = 'user' AND conv_id % 9 = 5 THEN concat('Direction: x', chr(10), 'English: ', text)
         ELSE text END AS content,
    CASE conv_id % 3 WHEN 0 THEN 'en-es' WHEN 1 THEN 'es-en' END AS direction
  FROM conversations)""",
    "fx_chat": """fx_chat AS (
  SELECT conv_id, list({'role': role, 'content': content} ORDER BY turn) AS messages,
    max(direction) AS md_direction
  FROM fx_turns GROUP BY conv_id)""",
    "fx_chat2": """fx_chat1 AS (
  SELECT *,
    array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: coalesce(m.content, '')), chr(10)) AS user_text,
    (len(messages) > 0 AND messages[-1].role = 'assistant') AS ends_assistant
  FROM fx_chat),
fx_chat2 AS (
  SELECT conv_id, messages, md_direction,
    CASE WHEN md_direction IS NOT NULL AND md_direction <> '' THEN md_direction
         WHEN contains(user_text, 'Spanish to English') OR contains(user_text, 'Spanish:') THEN 'es-en'
         WHEN contains(user_text, 'English to Spanish') OR contains(user_text, 'English:') THEN 'en-es'
         ELSE 'unknown' END AS direction,
    CASE WHEN ends_assistant THEN messages[1:len(messages) - 1] ELSE messages END AS pm,
    CASE WHEN ends_assistant THEN coalesce(messages[-1].content, '') ELSE '' END AS reference
  FROM fx_chat1)""",
    "fx_cases": """fx_cases AS (
  SELECT a.doc_id AS row_index, CASE a.doc_id % 2 WHEN 0 THEN 'en-es' ELSE 'es-en' END AS direction,
    CASE WHEN a.doc_id % 10 = 9 THEN '' ELSE a.text END AS reference_text,
    CASE a.doc_id % 4 WHEN 0 THEN concat('  ', lower(a.text), ' ')
                      WHEN 1 THEN replace(a.text, ' the ', ' 😀 ')
                      WHEN 2 THEN concat(coalesce(b.text, ''), '<|im_end|>tail')
                      ELSE CASE WHEN a.doc_id % 40 = 3 THEN '' ELSE concat(' ', replace(a.text, 'e', 'a'), chr(9), ' ') END END AS raw_prediction
  FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)""",
    "fx_runs": """fx_runs_base AS (
  SELECT c.conv_id, c.turn, c.role, c.text, n.text AS next_text
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
fx_runs_fan AS (
  SELECT 0 AS run, 'en-es' AS direction, 0 AS k, conv_id, turn, text, next_text FROM fx_runs_base
  UNION ALL SELECT 0, 'es-en', 1, conv_id, turn, text, next_text FROM fx_runs_base
  UNION ALL SELECT 1, 'en-es', 0, conv_id, turn, text, next_text FROM fx_runs_base
  UNION ALL SELECT 1, 'es-en', 1, conv_id, turn, text, next_text FROM fx_runs_base),
fx_runs AS (
  SELECT run, conv_id, turn, direction, text AS reference_text,
    CASE (conv_id + turn + run + k) % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'o', 'u')
         ELSE coalesce(next_text, '') END AS raw_prediction
  FROM fx_runs_fan)""",
}
DEPS = {"fx_chat": ["fx_turns"], "fx_chat2": ["fx_turns", "fx_chat"]}


def with_fx(body: str, *names) -> str:
    order = []
    for n in names:
        for d in DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(FX[n] for n in order)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"


# ------------------------------------------------------------------ shared SQL fragments

PAIRS_CHECKED = f"""checked AS (
  SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {missing(c)} THEN '{c}' END" for c in REQ)}) AS missing_fields,
    CAST({" + ".join(f"CASE WHEN {missing(c)} THEN 1 ELSE 0 END" for c in REQ)} AS BIGINT) AS n_missing,
    {VALID} AS valid,
    CASE WHEN {h(SEED, 'pair_id')} < 0.02 * 4294967296 THEN 'validation' ELSE 'train' END AS split
  FROM fx_pairs)"""

EXAMPLES = f"""WITH {PAIRS_CHECKED},
dirs AS (SELECT 'en-es' AS direction UNION ALL SELECT 'es-en'),
ex AS (
  SELECT c.*, d.direction,
    CASE WHEN d.direction = 'en-es' THEN english_scenario ELSE spanish_translation END AS source_text,
    CASE WHEN d.direction = 'en-es' THEN spanish_translation ELSE english_scenario END AS target_text
  FROM checked c JOIN dirs d ON TRUE WHERE c.valid)"""


def _markup(msgs: str) -> str:
    return (f"array_to_string(list_transform({msgs}, lambda m: concat('<|im_start|>', coalesce(m.role, ''), {NL}, "
            f"coalesce(m.content, ''), '<|im_end|>', {NL})), '')")


ENCODED = EXAMPLES + f""",
enc0 AS (
  SELECT pair_id, direction, split,
    [{{'role': 'system', 'content': {sys_prompt('direction')}}},
     {{'role': 'user', 'content': {structured('direction', 'style', 'target_length', 'source_text')}}}] AS pmsgs,
    target_text FROM ex),
enc1 AS (
  SELECT pair_id, direction, split,
    {ntok(_markup("list_append(pmsgs, {'role': 'assistant', 'content': target_text})"))} AS full_n,
    {ntok("concat(" + _markup("pmsgs") + ", '<|im_start|>assistant', chr(10))")} AS prompt_n
  FROM enc0),
enc AS (
  SELECT pair_id, direction, split, least(full_n, {Q.MAX_LEN}) AS n_input_ids, least(prompt_n, {Q.MAX_LEN}) AS prompt_len
  FROM enc1)"""


def render_plain(msgs: str, cue: bool = False) -> str:
    parts = (f"list_transform({msgs}, lambda m: concat(CASE m.role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' "
             f"WHEN 'assistant' THEN 'Assistant' ELSE m.role END, ': ', coalesce(m.content, '')))")
    if cue:
        parts = f"list_append({parts}, 'Assistant:')"
    return f"array_to_string({parts}, chr(10))"


def prompt_only(msgs: str) -> str:
    kept = f"list_filter({msgs}, lambda m: m.role IS NULL OR m.role <> 'assistant')"
    turns = f"list_transform({kept}, lambda m: concat('<|im_start|>', coalesce(m.role, 'None'), chr(10), coalesce(m.content, ''), '<|im_end|>'))"
    return f"concat(array_to_string({turns}, chr(10)), chr(10))"


def full_plain(pm: str, ref: str) -> str:
    appended = f"list_append({pm}, {{'role': 'assistant', 'content': {ref}}})"
    return f"CASE WHEN {ref} <> '' THEN {render_plain(appended)} ELSE {render_plain(pm)} END"


def source_text(msgs: str) -> str:
    users = f"list_filter({msgs}, lambda m: m.role = 'user')"
    c = f"coalesce(({users})[-1].content, '')"
    a, b = "chr(10) || 'English: '", "'English: '"
    picked = (f"CASE WHEN strpos({c}, {a}) > 0 THEN substring({c}, strpos({c}, {a}) + 10) "
              f"WHEN strpos({c}, {b}) > 0 THEN substring({c}, strpos({c}, {b}) + 9) ELSE {c} END")
    return f"CASE WHEN len({users}) > 0 THEN {strip(picked)} ELSE '' END"


BALANCED = f"""base AS (SELECT conv_id, direction, messages, md_direction, pm, reference, {h(SEED, 'conv_id')} AS h FROM fx_chat2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY h, conv_id) AS rn FROM base),
g1 AS (SELECT direction, count(*) AS g FROM base GROUP BY direction),
g2 AS (SELECT direction, g, row_number() OVER (ORDER BY direction) - 1 AS off, count(*) OVER () AS k,
              sum(g) OVER () AS total FROM g1),
g3 AS (SELECT *, least(g, {N_CAL} // k + CASE WHEN off < {N_CAL} % k THEN 1 ELSE 0 END) AS quota FROM g2),
g4 AS (SELECT *, least({N_CAL}, total) - sum(quota) OVER () AS needed FROM g3),
cand AS (SELECT r.*, quota, needed FROM ranked r JOIN g4 USING (direction) WHERE rn <= {N_CAL}),
chosen AS (SELECT * FROM cand WHERE rn <= quota),
topup AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, conv_id) AS trn FROM cand WHERE rn > quota)
          WHERE trn <= needed),
sample AS (SELECT * EXCLUDE (trn) FROM topup UNION ALL SELECT * FROM chosen),
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS sample_id FROM sample)"""


EMPTY = "''"


def _score_sql(src: str, keys: str, extra: str = "") -> str:
    """Per-case exact match, token F1 and chrF-like from the definition (unrounded)."""
    return f"""sc0 AS (SELECT {keys}, {extra} {clean('raw_prediction')} AS prediction, reference_text FROM {src}),
sc1 AS (SELECT *, {norm('prediction')} AS np, {norm('reference_text')} AS nr, reference_text <> '' AS scored FROM sc0),
sides AS (SELECT {keys}, 0 AS side, np AS t FROM sc1 WHERE scored AND np <> ''
          UNION ALL SELECT {keys}, 1, nr FROM sc1 WHERE scored AND nr <> ''),
toks AS (SELECT {keys}, side, 0 AS ord, unnest(string_split(t, ' ')) AS item FROM sides),
chars AS (SELECT {keys}, side, length(t) AS len, unnest(regexp_extract_all(t, '(?s).')) AS c,
          unnest(range(1, length(t) + 1)) AS i FROM sides),
win AS (SELECT {keys}, side, len, i, c AS g1, {", ".join(f"c || {' || '.join(f'coalesce(lead(c, {k}) OVER w, {EMPTY})' for k in range(1, o))} AS g{o}" for o in range(2, 7))}
        FROM chars WINDOW w AS (PARTITION BY {keys}, side ORDER BY i)),
grams AS (SELECT {keys}, side, ord, item
          FROM (SELECT {keys}, side, len, i, unnest([1, 2, 3, 4, 5, 6]) AS ord, unnest([g1, g2, g3, g4, g5, g6]) AS item FROM win)
          WHERE i + ord - 1 <= len OR i = 1),
items AS (SELECT * FROM toks UNION ALL SELECT * FROM grams),
per_item AS (SELECT {keys}, ord, item, count(*) FILTER (WHERE side = 0) AS cp, count(*) FILTER (WHERE side = 1) AS cr
             FROM items GROUP BY ALL),
ov AS (SELECT {keys}, ord, sum(least(cp, cr)) AS ov FROM per_item GROUP BY ALL),
ovw AS (SELECT {keys}, {", ".join(f"coalesce(sum(ov) FILTER (WHERE ord = {o}), 0) AS ov{o}" for o in range(7))}
        FROM ov GROUP BY ALL),
sc2 AS (SELECT sc1.*, {", ".join(f"coalesce(ovw.ov{o}, 0)::DOUBLE AS ov{o}" for o in range(7))},
          CAST(CASE WHEN np = '' THEN 0 ELSE len(string_split(np, ' ')) END AS DOUBLE) AS tp,
          CAST(CASE WHEN nr = '' THEN 0 ELSE len(string_split(nr, ' ')) END AS DOUBLE) AS tr,
          length(np) AS lp, length(nr) AS lr
        FROM sc1 LEFT JOIN ovw USING ({keys})),
scored AS (SELECT {keys}, {extra} prediction, reference_text,
  CASE WHEN scored THEN CAST(np = nr AS INTEGER) END AS exact_match,
  CASE WHEN scored THEN {_f1()} END AS token_f1,
  CASE WHEN scored THEN ({" + ".join(_fb(o) for o in range(1, 7))}) / 6.0 END AS chrf_like
  FROM sc2)"""


def _size(l: str, n: int) -> str:
    return f"CAST(CASE WHEN {l} = 0 THEN 0 WHEN {l} < {n} THEN 1 ELSE {l} - {n} + 1 END AS DOUBLE)"


def _fb(o: int) -> str:
    tp, tr, ov = _size("lp", o), _size("lr", o), f"ov{o}"
    p, r = f"({ov} / {tp})", f"({ov} / {tr})"
    return (f"(CASE WHEN {tp} = 0 AND {tr} = 0 THEN 1.0 WHEN {tp} = 0 OR {tr} = 0 THEN 0.0 "
            f"WHEN {p} = 0 AND {r} = 0 THEN 0.0 ELSE (5.0 * {p} * {r}) / (4.0 * {p} + {r}) END)")


def _f1() -> str:
    p, r = "(ov0 / tp)", "(ov0 / tr)"
    return (f"(CASE WHEN tp = 0 AND tr = 0 THEN 1.0 WHEN tp = 0 OR tr = 0 THEN 0.0 WHEN ov0 = 0 THEN 0.0 "
            f"ELSE (2.0 * {p} * {r}) / ({p} + {r}) END)")


def r6(c: str) -> str:
    return f"round({c}, 6) AS {c}"


CASES_SCORED = "WITH " + _score_sql("fx_cases", "row_index", "direction,")
RUNS_SCORED = "WITH " + _score_sql("fx_runs", "run, conv_id, turn, direction")
RUN_KEY = "conv_id, turn, direction"


SQL = {
    # ---------------------------------------------------------- prepare side
    "validate_missing": with_fx(f"WITH {PAIRS_CHECKED} SELECT pair_id, missing_fields, n_missing FROM checked", "fx_pairs"),
    "quarantine_rows": with_fx(f"""WITH {PAIRS_CHECKED},
numbered AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS row_number FROM checked)
SELECT row_number, concat('fx_pairs row ', row_number, ' missing required fields: [',
  concat_ws(', ', {", ".join(f"CASE WHEN {missing(c)} THEN '''{c}''' END" for c in REQ)}), ']') AS error,
  style, pair_id
FROM numbered WHERE NOT valid""", "fx_pairs"),
    "limit_source": with_fx(f"""WITH {PAIRS_CHECKED},
numbered AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS row_number FROM checked)
SELECT pair_id, row_number, valid FROM numbered WHERE row_number <= {Q.SMOKE_LIMIT}""", "fx_pairs"),
    "prepare_stats": with_fx(f"""WITH {PAIRS_CHECKED}
SELECT count(*) AS source_rows, count(*) FILTER (WHERE NOT valid) AS skipped,
  2 * count(*) FILTER (WHERE valid AND split = 'train') AS train,
  2 * count(*) FILTER (WHERE valid AND split = 'validation') AS validation,
  2 * count(*) FILTER (WHERE valid) AS total
FROM checked""", "fx_pairs"),
    "split_hash": with_fx(f"WITH {PAIRS_CHECKED} SELECT pair_id, split FROM checked WHERE valid", "fx_pairs"),
    "chat_examples": with_fx(EXAMPLES + f"""
SELECT pair_id, direction, split, {sys_prompt('direction')} AS system_content,
  {structured('direction', 'style', 'target_length', 'source_text')} AS user_content,
  target_text AS assistant_content, term, target_length, style
FROM ex""", "fx_pairs"),
    "expand_directions": with_fx(EXAMPLES + """
SELECT pair_id AS row_index, direction, term, target_length, style, source_text, target_text AS reference_text FROM ex""",
                                 "fx_pairs"),
    "prompt_structured": with_fx(EXAMPLES + f"""
SELECT pair_id AS row_index, direction, {sys_prompt('direction')} AS system_content,
  {structured('direction', 'style', 'target_length', 'source_text')} AS user_content FROM ex""", "fx_pairs"),
    "prompt_simple": with_fx(EXAMPLES + f"""
SELECT pair_id AS row_index, direction, {simple_prompt('direction')} AS system_content,
  coalesce(source_text, '') AS user_content FROM ex""", "fx_pairs"),
    "prompt_baseline": with_fx(f"""SELECT pair_id, {lit(BASELINE_SYSTEM_PROMPT)} AS system_content,
  concat('English: ', coalesce(english_scenario, '')) AS user_content FROM fx_pairs""", "fx_pairs"),
    "split_explicit": with_fx(f"""WITH bench AS (
  SELECT item_id AS pair_id, 'benchmark' AS term,
    CAST(length(text) - length(replace(text, ' ', '')) + 1 AS VARCHAR) AS target_length, 'formal' AS style,
    text AS english_scenario, text AS spanish_translation FROM benchmark),
both_inputs AS (
  SELECT 'train' AS split, CAST(pair_id AS VARCHAR) AS pair_id FROM fx_pairs WHERE {VALID}
  UNION ALL SELECT 'validation', CAST(pair_id AS VARCHAR) FROM bench WHERE {VALID})
SELECT split, pair_id, d.direction FROM both_inputs JOIN (SELECT 'en-es' AS direction UNION ALL SELECT 'es-en') d ON TRUE""",
                              "fx_pairs"),
    "split_train_all": with_fx(f"SELECT 'train' AS split, 2 * count(*) AS n_examples FROM fx_pairs WHERE {VALID}", "fx_pairs"),
    "split_cap": with_fx(EXAMPLES + f""",
capped AS (SELECT split, pair_id, direction,
  row_number() OVER (PARTITION BY split ORDER BY pair_id, direction) AS rn FROM ex)
SELECT split, pair_id, direction FROM capped
WHERE (split = 'train' AND rn <= {Q.TRAIN_CAP}) OR (split = 'validation' AND rn <= {Q.VALIDATION_CAP})""", "fx_pairs"),
    "encode_truncate": with_fx(ENCODED + " SELECT pair_id, direction, n_input_ids, prompt_len FROM enc", "fx_pairs"),
    "mask_labels": with_fx(ENCODED + """
SELECT pair_id, direction, least(prompt_len, n_input_ids) AS n_masked, n_input_ids AS n_labels FROM enc""", "fx_pairs"),
    "supervised_filter": with_fx(ENCODED + " SELECT pair_id, direction, split FROM enc WHERE n_input_ids > prompt_len",
                                 "fx_pairs"),
    "truncation_report": with_fx(ENCODED + """
SELECT split, count(*) AS before, count(*) FILTER (WHERE n_input_ids > prompt_len) AS after,
  count(*) FILTER (WHERE n_input_ids <= prompt_len) AS removed FROM enc GROUP BY split""", "fx_pairs"),
    "predict_batches": with_fx(f"""SELECT pair_id,
  {strip("translate(coalesce(english_scenario, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")} AS prediction
FROM fx_pairs""", "fx_pairs"),
    "multi_model_wide": with_fx(f"""SELECT pair_id,
  {strip("translate(coalesce(english_scenario, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")} AS upper_model_translation,
  'ERROR' AS broken_model_translation
FROM fx_pairs""", "fx_pairs"),
    # ---------------------------------------------------------- calibration side
    "infer_direction": with_fx("SELECT conv_id, direction FROM fx_chat2", "fx_chat2"),
    "split_reference": with_fx("SELECT conv_id, CAST(len(pm) AS BIGINT) AS n_prompt_messages, reference FROM fx_chat2",
                               "fx_chat2"),
    "render_plain": with_fx(f"SELECT conv_id, {render_plain('messages')} AS plain_text FROM fx_chat2", "fx_chat2"),
    "render_prompt_only": with_fx(f"SELECT conv_id, {prompt_only('pm')} AS prompt_only FROM fx_chat2", "fx_chat2"),
    "format_texts": with_fx(f"""SELECT conv_id, {render_plain('pm', cue=True)} AS prompt,
  {full_plain('pm', 'reference')} AS full_text, reference FROM fx_chat2""", "fx_chat2"),
    "token_count": with_fx(f"SELECT conv_id, {ntok(prompt_only('pm'))} AS token_length FROM fx_chat2", "fx_chat2"),
    "length_bucket": f"""SELECT doc_id, {ntok('text')} AS n_tokens, {bucket(ntok('text'))} AS bucket FROM documents""",
    "bucket_counts": f"""SELECT bucket, count(*) AS n FROM (SELECT {bucket(ntok('text'))} AS bucket FROM documents) GROUP BY bucket""",
    "flatten_text": with_fx(f"""SELECT conv_id, {flat(render_plain('pm', cue=True))} AS flat_prompt,
  {flat(full_plain('pm', 'reference'))} AS flat_full FROM fx_chat2""", "fx_chat2"),
    "source_text": with_fx(f"SELECT conv_id, {source_text('messages')} AS source_text FROM fx_chat2", "fx_chat2"),
    "segment_flatten": with_fx(f"""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN concat('seg-', conv_id) ELSE CAST(conv_id + 1 AS VARCHAR) END AS segment_id,
  CASE WHEN conv_id % 3 = 0 THEN 'north' ELSE '' END AS accent, '' AS youtube_id, '' AS start_time, '' AS duration, {source_text('messages')} AS source_text FROM fx_chat2""", "fx_chat2"),
    "sample_uniform": with_fx(f"""WITH s AS (SELECT conv_id FROM fx_chat2 ORDER BY {h(SEED, 'conv_id')}, conv_id LIMIT {N_CAL})
SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS sample_id FROM s""", "fx_chat2"),
    "sample_balanced": with_fx(f"WITH {BALANCED} SELECT conv_id, direction FROM chosen", "fx_chat2"),
    "sample_balanced_topup": with_fx(f"WITH {BALANCED} SELECT conv_id, direction FROM sample", "fx_chat2"),
    "anti_remaining": with_fx(f"""WITH {BALANCED}
SELECT conv_id, direction FROM fx_chat2 WHERE conv_id NOT IN (SELECT conv_id FROM chosen)""", "fx_chat2"),
    "calibration_records": with_fx(f"""WITH {BALANCED}
SELECT concat(sample_id + 1, '_prompt_only') AS id, {prompt_only('pm')} AS text,
  concat('{DEFAULT_TASK_PREFIX}_', replace(direction, '-', '_')) AS task, CAST(NULL AS VARCHAR) AS dataset_version,
  'prompt_only' AS mode, {bucket(ntok(prompt_only('pm')))} AS bucket, {ntok(prompt_only('pm'))} AS token_length,
  CAST(conv_id + 1 AS BIGINT) AS source_line_no, CAST(NULL AS VARCHAR) AS meeting_id, CAST(NULL AS VARCHAR) AS segment_id
FROM numbered""", "fx_chat2"),
    "calibration_prompts": with_fx(f"""WITH {BALANCED}
SELECT sample_id, conv_id AS source_index, direction, {render_plain('pm', cue=True)} AS prompt,
  {full_plain('pm', 'reference')} AS full_text, reference, md_direction AS metadata_direction
FROM numbered""", "fx_chat2"),
    "direction_counts": with_fx("SELECT direction, count(*) AS n FROM fx_chat2 GROUP BY direction", "fx_chat2"),
    "direction_ratio": with_fx("""SELECT direction, n, round(n / sum(n) OVER (), 4) AS ratio
FROM (SELECT direction, count(*) AS n FROM fx_chat2 GROUP BY direction)""", "fx_chat2"),
    "replicate_weighted": with_fx("""WITH f AS (SELECT conv_id, direction,
  CASE direction WHEN 'en-es' THEN 2 WHEN 'es-en' THEN 1 ELSE 1 END AS factor FROM fx_chat2)
SELECT conv_id, direction, CAST(unnest(range(0, factor)) AS BIGINT) AS copy FROM f""", "fx_chat2"),
    "shuffle_order": with_fx(f"""WITH f AS (SELECT conv_id, direction,
  CASE direction WHEN 'en-es' THEN 2 WHEN 'es-en' THEN 1 ELSE 1 END AS factor FROM fx_chat2),
r AS (SELECT conv_id, CAST(unnest(range(0, factor)) AS BIGINT) AS copy FROM f),
{permutation_sql("r", "conv_id, copy", SEED)} SELECT conv_id, copy, position FROM permuted""", "fx_chat2").replace("WITH ", "WITH RECURSIVE ", 1),
    "weight_validation": with_fx(f"""WITH s AS (SELECT conv_id, direction,
  CASE WHEN {h(SEED, 'conv_id')} < {Q.CHAT_VALIDATION_RATIO} * 4294967296 THEN 'validation' ELSE 'train' END AS split,
  CASE direction WHEN 'en-es' THEN 2 WHEN 'es-en' THEN 1 ELSE 1 END AS factor FROM fx_chat2)
SELECT split, direction, CAST(sum(factor) AS BIGINT) AS n FROM s GROUP BY split, direction""", "fx_chat2"),
    "reweight_report": with_fx(f"""WITH s AS (SELECT conv_id, direction,
  CASE WHEN {h(SEED, 'conv_id')} < {Q.CHAT_VALIDATION_RATIO} * 4294967296 THEN 'validation' ELSE 'train' END AS split,
  CASE direction WHEN 'en-es' THEN 2 WHEN 'es-en' THEN 1 ELSE 1 END AS factor FROM fx_chat2),
g AS (SELECT split, direction, count(*) AS input_count,
  CAST(sum(CASE WHEN split = 'train' THEN factor ELSE 1 END) AS BIGINT) AS output_count FROM s GROUP BY split, direction),
t AS (SELECT *, CAST(sum(input_count) OVER (PARTITION BY split) AS BIGINT) AS input_total,
  CAST(sum(output_count) OVER (PARTITION BY split) AS BIGINT) AS output_total FROM g)
SELECT split, direction, input_count, output_count, input_total, output_total,
  round(input_count / input_total, 4) AS input_ratio,
  CASE WHEN output_total > 0 THEN round(output_count / output_total, 4) END AS output_ratio FROM t""", "fx_chat2"),
    # ---------------------------------------------------------- evaluation side
    "clean_prediction": with_fx(f"SELECT row_index, {clean('raw_prediction')} AS prediction FROM fx_cases", "fx_cases"),
    "normalize_text": with_fx(f"""SELECT row_index, {norm(clean('raw_prediction'))} AS norm_prediction,
  {norm('reference_text')} AS norm_reference FROM fx_cases""", "fx_cases"),
    "exact_match": with_fx(f"""SELECT row_index, CASE WHEN reference_text <> ''
  THEN CAST({norm(clean('raw_prediction'))} = {norm('reference_text')} AS INTEGER) END AS exact_match FROM fx_cases""",
                           "fx_cases"),
    "token_f1": with_fx(CASES_SCORED + f" SELECT row_index, {r6('token_f1')} FROM scored", "fx_cases"),
    "chrf_like": with_fx(CASES_SCORED + f" SELECT row_index, {r6('chrf_like')} FROM scored", "fx_cases"),
    "char_ngrams": with_fx(CASES_SCORED + """
SELECT row_index, side, ord, count(*) AS n_grams, count(DISTINCT item) AS n_distinct FROM grams GROUP BY ALL""",
                           "fx_cases"),
    "bag_overlap": with_fx(CASES_SCORED + """
SELECT row_index, o.ord, CAST(CASE o.ord WHEN 0 THEN ov0 WHEN 1 THEN ov1 WHEN 2 THEN ov2 WHEN 3 THEN ov3
  WHEN 4 THEN ov4 WHEN 5 THEN ov5 ELSE ov6 END AS BIGINT) AS overlap
FROM ovw JOIN (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS ord) o ON TRUE""", "fx_cases"),
    "score_predictions": with_fx(CASES_SCORED + f"""
SELECT row_index, direction, prediction, exact_match, {r6('token_f1')}, {r6('chrf_like')} FROM scored""", "fx_cases"),
    "eval_summary": with_fx(CASES_SCORED + f"""
SELECT CASE WHEN GROUPING(direction) = 1 THEN 'overall' ELSE 'direction' END AS level, direction,
  count(*) AS num_examples, count(*) FILTER (WHERE reference_text <> '') AS num_scored_examples,
  round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(chrf_like), 6) AS chrf_like,
  CASE WHEN GROUPING(direction) = 1 AND count(*) FILTER (WHERE reference_text <> '') = 0
       THEN {lit(NO_METRICS_NOTE)} END AS metrics_note
FROM scored GROUP BY GROUPING SETS ((), (direction))""", "fx_cases"),
    "compare_runs": with_fx(RUNS_SCORED + f""",
a AS (SELECT * FROM scored WHERE run = 0), b AS (SELECT * FROM scored WHERE run = 1)
SELECT {RUN_KEY},
  a.exact_match AS exact_match_a, round(a.token_f1, 6) AS token_f1_a, round(a.chrf_like, 6) AS chrf_like_a,
  b.exact_match AS exact_match_b, round(b.token_f1, 6) AS token_f1_b, round(b.chrf_like, 6) AS chrf_like_b,
  b.exact_match - a.exact_match AS exact_match_delta, round(b.token_f1 - a.token_f1, 6) AS token_f1_delta,
  round(b.chrf_like - a.chrf_like, 6) AS chrf_like_delta
FROM a JOIN b USING ({RUN_KEY})""", "fx_runs"),
    "regression_gate": with_fx(RUNS_SCORED + f""",
j AS (SELECT {RUN_KEY}, a.chrf_like AS ma, b.chrf_like AS mb FROM (SELECT * FROM scored WHERE run = 0) a
      JOIN (SELECT * FROM scored WHERE run = 1) b USING ({RUN_KEY}) WHERE a.chrf_like IS NOT NULL AND b.chrf_like IS NOT NULL),
d AS (SELECT direction, avg(mb) - avg(ma) AS delta, count(*) AS n_cases FROM j GROUP BY direction),
v AS (SELECT max(delta) FILTER (WHERE direction = 'en-es') AS up, max(delta) FILTER (WHERE direction = 'es-en') AS down,
  sum(n_cases) AS n_cases FROM d)
SELECT round(up, 6) AS improve_delta, round(down, 6) AS guard_delta, CAST(n_cases AS BIGINT) AS n_cases,
  coalesce(up > 0 AND down >= -0.01, false) AS accepted FROM v""", "fx_runs"),
    "same_cases": with_fx(RUNS_SCORED + f"""
SELECT {RUN_KEY}, round(chrf_like, 6) AS chrf_like FROM scored a WHERE run = 0
  AND EXISTS (SELECT 1 FROM scored b WHERE b.run = 1 AND b.conv_id = a.conv_id AND b.turn = a.turn AND b.direction = a.direction)
  AND a.conv_id IN (SELECT doc_id FROM labels)""",
                          "fx_runs"),
    "baseline_carry": with_fx(RUNS_SCORED + f"""
SELECT {RUN_KEY}, a.prediction, coalesce(b.prediction, '') AS baseline_prediction,
  coalesce(CAST(b.exact_match AS VARCHAR), '') AS baseline_exact_match
FROM (SELECT * FROM scored WHERE run = 0) a LEFT JOIN (SELECT * FROM scored WHERE run = 1 AND conv_id IN (SELECT doc_id FROM labels)) b USING ({RUN_KEY})""", "fx_runs"),
    "row_index": "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_index FROM documents",
    # ---------------------------------------------------------- sources and sinks
    "scan_csv_roundtrip": with_fx("""SELECT nullif(term, '') AS term, nullif(target_length, '') AS target_length,
  nullif(style, '') AS style, nullif(english_scenario, '') AS english_scenario,
  nullif(spanish_translation, '') AS spanish_translation, row_number() OVER (ORDER BY pair_id) AS row_number
FROM fx_pairs""", "fx_pairs"),
    "scan_jsonl_roundtrip": with_fx(f"""WITH {PAIRS_CHECKED}
SELECT term, target_length, style, english_scenario, spanish_translation,
  row_number() OVER (ORDER BY pair_id) AS row_number, missing_fields FROM checked""", "fx_pairs"),
    "chat_scan_messages": with_fx("""SELECT row_number() OVER (ORDER BY conv_id) AS line_no, conv_id,
  CAST(len(messages) AS BIGINT) AS n_messages, messages[1].role AS first_role, messages[-1].role AS last_role,
  md_direction AS metadata_direction FROM fx_chat2""", "fx_chat2"),
    "routed_splits": with_fx(f"""WITH {PAIRS_CHECKED}
SELECT pair_id, CASE WHEN valid THEN split ELSE 'rejected' END AS route, term, spanish_translation FROM checked""", "fx_pairs"),
    "text_lines": f"SELECT {flat('text')} AS line, count(*) AS n FROM documents GROUP BY 1",
    "chat_rewrite": with_fx("""SELECT conv_id, CAST(len(messages) AS BIGINT) AS n_messages,
  't-' || row_number() OVER (ORDER BY conv_id) AS translation FROM fx_chat2""", "fx_chat2"),
    "split_union": with_fx(f"""SELECT CASE WHEN {h(SEED, 'conv_id')} < {Q.CHAT_VALIDATION_RATIO} * 4294967296
  THEN 'validation' ELSE 'train' END AS split, conv_id, CAST(len(messages) AS BIGINT) AS n_messages FROM fx_chat2""",
                           "fx_chat2"),
    "cases_reuse": with_fx(f"""SELECT 'en-es' AS direction, row_index, coalesce(reference_text, '') AS source_text,
  coalesce(reference_text, '') AS reference_text, coalesce({clean('raw_prediction')}, '') AS baseline_prediction,
  {structured("'en-es'", "''", "''", "coalesce(reference_text, '')")} AS user_content
FROM fx_cases WHERE coalesce(CASE WHEN row_index % 3 = 0 THEN NULL ELSE direction END, 'en-es') = 'en-es'""", "fx_cases"),
}
