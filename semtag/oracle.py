"""SQL that DuckDB answers from the same tables, for each registered query that SQL can express."""

from __future__ import annotations

from .operators.rules import HEADERS, PATTERNS
from .operators.prompts import selection_frame, table_frame, text_frame
from .operators.vocab import BUILT_IN, COARSE, FINE_TO_COARSE, STI_TO_COARSE


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _map_case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _size(task_id: str, text: str) -> str:
    escaped = lambda x: f"length(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{10000}}-\\x{{10FFFF}}]', '############', 'g'), '[\"\\\\\\n\\r\\t\\x08\\x0c]', '##', 'g'), '[^ -~]', '######', 'g'))"
    return f"{escaped(task_id)} + {escaped(text)} + 27"


FTEXT = f"SELECT source AS job_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, CAST(doc_id AS VARCHAR) AS task_id, {_size('CAST(doc_id AS VARCHAR)', 'text')} AS size FROM documents"
FTURN = f"SELECT CAST(conv_id % 8 AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS ord, {_size('concat(conv_id, chr(45), turn)', 'text')} AS size FROM conversations"


def _pack(tasks: str) -> str:
    return f"""
WITH RECURSIVE t AS ({tasks}),
r AS (
  SELECT job_id, ord, size, CAST(0 AS BIGINT) AS batch, 1 AS n, size AS chars FROM t WHERE ord = 1
  UNION ALL
  SELECT t.job_id, t.ord, t.size, r.batch + CASE WHEN r.n + 1 > 10 OR r.chars + t.size > 12000 THEN 1 ELSE 0 END,
         CASE WHEN r.n + 1 > 10 OR r.chars + t.size > 12000 THEN 1 ELSE r.n + 1 END,
         CASE WHEN r.n + 1 > 10 OR r.chars + t.size > 12000 THEN t.size ELSE r.chars + t.size END
  FROM r JOIN t ON t.job_id = r.job_id AND t.ord = r.ord + 1
)
SELECT job_id, ord, CAST(size AS BIGINT) AS size, batch FROM r"""


JOBS = "SELECT event_id AS job_id, (['ner', 'tabular', 'other'])[event_id % 3 + 1] AS endpoint_type, (['coarse', 'fine', 'sti', 'dpv', 'nope'])[event_id % 5 + 1] AS schema, event_id % 4 AS n_tasks, ts AS created_at FROM events"
STATE = """SELECT * FROM (SELECT user_id AS job_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
CUSTOMERS = "SELECT concat('nation', c_nationkey) AS table_id, c_nationkey AS k, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer"
SCORES = f"SELECT doc_id, CAST(i AS INTEGER) AS idx, ({_list(COARSE)})[i + 1] AS type_id, ((doc_id * 7 + i * 13) % 11) / CAST(10 AS DOUBLE) AS score FROM documents, range(12) t(i)"
POSTERIOR = f"""SELECT doc_id, idx, type_id, CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0::DOUBLE / 12 END AS p
  FROM (SELECT doc_id, idx, type_id, CASE WHEN doc_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE score END AS s FROM ({SCORES})) WINDOW w AS (PARTITION BY doc_id)"""
BEST = f"""SELECT doc_id, type_id, round(p, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, idx) AS r FROM ({POSTERIOR})) WHERE r = 1"""
#: Batches of five documents: the fault of each attempt, and which attempt counts.
ATTEMPTS = """SELECT DISTINCT b AS batch_id, concat('job', b % 20) AS job_id, a AS attempt,
    CASE WHEN a = 0 THEN b % 8 WHEN a = 1 AND b % 16 = 0 THEN 5 WHEN a = 2 AND b % 32 = 0 THEN 5 ELSE 7 END AS fault
  FROM (SELECT doc_id // 5 AS b FROM documents), range(3) t(a)"""
ERRORS = f"""SELECT job_id, batch_id, CAST(attempt AS INTEGER) AS attempt,
    (['missing_task', 'missing_task', 'bad_offsets', 'text_mismatch', 'bad_offsets', 'unknown_score_key', 'no_json', NULL])[fault + 1] AS error_code FROM ({ATTEMPTS})"""
SETTLED = f"""SELECT job_id, batch_id, min(CASE WHEN error_code IS NULL THEN attempt END) AS attempt,
    CASE WHEN min(CASE WHEN error_code IS NULL THEN attempt END) IS NULL THEN arg_max(error_code, attempt) END AS error_code FROM ({ERRORS}) GROUP BY ALL"""
ANNOTATIONS = f"""WITH bad AS (SELECT DISTINCT job_id FROM ({SETTLED}) WHERE attempt IS NULL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r, sum(score) OVER (PARTITION BY doc_id) AS total FROM ({SCORES})) WHERE r = 1),
  words AS (SELECT doc_id, concat('job', (doc_id // 5) % 20) AS job_id, regexp_extract(text, '[A-Za-z]+') AS word, text FROM documents)
SELECT w.job_id, w.doc_id AS ord, CAST(w.doc_id AS VARCHAR) AS task_id, 0 AS entity_idx, CAST(strpos(w.text, w.word) - 1 AS INTEGER) AS start,
  CAST(strpos(w.text, w.word) - 1 + length(w.word) AS INTEGER) AS "end", w.word AS text, type_id, round(score / total, 9) AS confidence
FROM words w JOIN best USING (doc_id) WHERE w.word <> '' AND w.job_id NOT IN (SELECT job_id FROM bad)"""


def _cell_type(column: str, value: str) -> str:
    parts = [f"WHEN lower({column}) IN ({', '.join(repr(n) for n in names)}) THEN '{t}'" for t, names in HEADERS]
    parts += [f"WHEN regexp_matches({value}, '{p}') THEN '{t}'" for t, p in PATTERNS]
    return "CASE " + " ".join(parts) + " ELSE 'LIT:STRING' END"


CELLS = """SELECT 'orders' AS table_id, unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority']) AS "column",
    unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) AS value FROM orders
  UNION ALL SELECT 'customer', unnest(['c_custkey', 'c_name', 'c_mktsegment']), unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) FROM customer
  UNION ALL SELECT 'pages', unnest(['page_id', 'url']), unnest([CAST(page_id AS VARCHAR), url]) FROM pages
  UNION ALL SELECT 'tokens', 'token', unnest(string_split(text, ' ')) FROM documents"""
TERMS = f"SELECT regexp_extract(text, '[A-Za-z]+') AS term, ({_list(COARSE)})[min(item_id) % 12 + 1] AS type_id FROM benchmark GROUP BY 1"
IRI = """CASE p_partkey % 6 WHEN 0 THEN concat('https://w3id.org/dpv#T', p_partkey // 2) WHEN 1 THEN concat('https://w3id.org/dpv/pd#T', p_partkey // 2)
  WHEN 2 THEN concat('https://w3id.org/dpv/#T', p_partkey // 2) WHEN 3 THEN concat('http://w3id.org/dpv/legal/eu#T', p_partkey) ELSE concat('https://example.org/x#T', p_partkey) END"""
SHORT = """CASE p_partkey % 6 WHEN 0 THEN concat('dpv:T', p_partkey // 2) WHEN 1 THEN concat('dpv-pd:T', p_partkey // 2) WHEN 2 THEN concat('dpv:T', p_partkey // 2)
  WHEN 3 THEN concat('dpv-legal/eu:T', p_partkey) ELSE concat('https://example.org/x#T', p_partkey) END"""
LABEL_OF = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('le ', p_name) WHEN 2 THEN p_name END"



def _echo(tasks: str) -> str:
    """What the echo model's answers come to: each task's first word (tasks: job_id, ord, task_id, text)."""
    return f"""
WITH w AS (SELECT *, regexp_extract(text, '[A-Za-z]+') AS word FROM ({tasks})),
s AS (SELECT *, list_transform(range(10), lambda i: length(word) % (i + 2) + 1) AS scores FROM w WHERE word <> ''),
b AS (SELECT *, list_sum(scores) AS total, list_max(scores) AS best, list_position(scores, list_max(scores)) AS i FROM s)
SELECT job_id, ord, task_id, 0 AS entity_idx, CAST(strpos(text, word) - 1 AS INTEGER) AS start, CAST(strpos(text, word) - 1 + length(word) AS INTEGER) AS "end", word AS text,
  ({_list(FINE_TO_COARSE)})[i] AS type_id, round(best / CAST(total AS DOUBLE), 9) AS confidence, ({_list(FINE_TO_COARSE.values())})[i] AS coarse_type_id,
  array_to_string(list_transform(scores, lambda x: CAST(round(x / CAST(total AS DOUBLE), 6) AS VARCHAR)), ' ') AS distribution FROM b"""


def _ascii(text: str) -> str:
    """A text as a JSON string in ASCII."""
    unit = lambda n: f"concat('\\u', lpad(lower(to_hex({n})), 4, '0'))"
    short = "CASE c WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' WHEN chr(8) THEN '\\b' WHEN chr(12) THEN '\\f' END"
    other = f"CASE WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN {unit('ord(c)')} ELSE concat({unit('55296 + (ord(c) - 65536) // 1024')}, {unit('56320 + (ord(c) - 65536) % 1024')}) END"
    return f"concat(chr(34), array_to_string(list_transform(regexp_extract_all({text}, '(?s)[ !#-\\[\\]-~]+|.'), lambda c: coalesce({short}, {other})), ''), chr(34))"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(text: str, payload: str) -> str:
    """A prompt made for an empty payload, with the SQL of its payload at the end."""
    return f"concat({_quote(text)}, {payload})"


_TEXT_PAYLOAD = f"concat('[', string_agg(concat('{{\"task_id\": ', {_ascii('task_id')}, ', \"text\": ', {_ascii('text')}, '}}'), ', ' ORDER BY ord), ']')"
_ROW = f"""concat('{{"c_custkey": ', {_ascii('CAST(c_custkey AS VARCHAR)')}, ', "c_name": ', {_ascii('name')}, CASE WHEN c_custkey % 2 = 0 THEN concat(', "c_mktsegment": ', {_ascii('c_mktsegment')}) ELSE '' END, '}}')"""
_NATION = f"SELECT table_id, k, concat('{{\"task_id\": \"task-', table_id, '\", \"table_id\": \"', table_id, '\", \"sampled_rows\": [', string_agg({_ROW}, ', ' ORDER BY n), ']}}') AS task FROM (SELECT c.*, x.c_name AS name FROM ({CUSTOMERS}) c JOIN customer x USING (c_custkey)) WHERE n <= 5 GROUP BY table_id, k"


TURNS = "SELECT CAST(conv_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, CAST(turn AS VARCHAR) AS task_id, text FROM conversations"
ORACLE_SQL: dict[str, str] = {
    "text_prompts": f"""
SELECT p.job_id, CAST(p.batch AS BIGINT) AS batch_id, {_prompt(text_frame(BUILT_IN["coarse"]), _TEXT_PAYLOAD)} AS prompt, {_prompt(selection_frame(BUILT_IN["coarse"], "text"), _TEXT_PAYLOAD)} AS selection_prompt
FROM ({_pack(FTEXT)}) p JOIN (SELECT source AS job_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, CAST(doc_id AS VARCHAR) AS task_id, text FROM documents) t USING (job_id, ord) GROUP BY p.job_id, p.batch""",
    "table_prompts": f"""
WITH n AS ({_NATION}), b AS ({_pack("SELECT 'nations' AS job_id, row_number() OVER (ORDER BY k) AS ord, length(task) AS size FROM (" + _NATION + ")")})
SELECT job_id, CAST(batch AS BIGINT) AS batch_id, {_prompt(table_frame(BUILT_IN["sti"]), "concat('[', string_agg(task, ', ' ORDER BY k), ']')")} AS prompt
FROM b JOIN (SELECT *, row_number() OVER (ORDER BY k) AS ord FROM n) USING (ord) GROUP BY job_id, batch""",
    "annotate_texts": _echo("SELECT source AS job_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, CAST(doc_id AS VARCHAR) AS task_id, text FROM documents"),
    "stream_annotations": f"SELECT * EXCLUDE (distribution) FROM ({_echo(TURNS)})",
    "stream_job_state": f"SELECT job_id, seq, status FROM ({STATE})",
    "stream_states": """
SELECT CAST(conv_id AS VARCHAR) AS job_id, CASE WHEN count(*) > 6 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN count(*) > 6 THEN 'no_json' END AS error FROM conversations GROUP BY conv_id""",
    "text_ner_replay": ANNOTATIONS,
    "column_typing_replay": f"""
WITH t AS (SELECT table_id, k, max(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END) AS has_segment FROM ({CUSTOMERS}) WHERE n <= 5 GROUP BY ALL),
  c AS (
    SELECT table_id, 'c_custkey' AS "column", 'xsd:integer' AS type_id, 0.75 AS confidence FROM t
    UNION ALL SELECT table_id, 'c_mktsegment', 'LIT:STRING', 1 FROM t WHERE has_segment = 1
    UNION ALL SELECT table_id, 'c_name', CASE WHEN k % 3 + 1 > 2 THEN 'NE:ORGANIZATION' ELSE 'NE:PERSON' END, greatest(k % 3 + 1, 2) / CAST(k % 3 + 3 AS DOUBLE) FROM t)
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY "column") - 1 AS INTEGER) AS column_idx, "column", type_id, round(CAST(confidence AS DOUBLE), 9) AS confidence,
  {_map_case("type_id", STI_TO_COARSE.items())} AS coarse_type_id FROM c""",
    "two_step_replay": """
WITH v AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT concat('dpv:', replace(p_name, ' ', '_')) AS t FROM part)),
  d AS (SELECT doc_id, doc_id // 5 AS b, regexp_extract(text, '[A-Za-z]+') AS word, text FROM documents),
  picked AS (SELECT b FROM (SELECT DISTINCT b FROM d), v WHERE b % 4 <> 0 AND (i + b) % 13 = 0 GROUP BY b),
  s AS (SELECT d.*, v.t, v.i, (doc_id * 7 + length(t) * 13) % 11 + 1 AS n FROM d, v WHERE d.b NOT IN (SELECT b FROM picked) OR (v.i + d.b) % 13 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r, sum(n) OVER (PARTITION BY doc_id) AS total FROM s WHERE word <> '')
SELECT doc_id AS ord, CAST(strpos(text, word) - 1 AS INTEGER) AS start, CAST(strpos(text, word) - 1 + length(word) AS INTEGER) AS "end", word AS text, t AS type_id, round(n / CAST(total AS DOUBLE), 9) AS confidence
FROM r WHERE r = 1""",
    "lines_to_tasks": f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{LINES}'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS ls FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS job_id, CAST(i AS BIGINT) AS ord, concat('t', i) AS task_id, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)""",
    "task_size": f"SELECT job_id, ord, task_id, CAST(size AS BIGINT) AS size FROM ({FTEXT})",
    "pack_batches": _pack(FTEXT),
    "pack_batches_turns": _pack(FTURN),
    "shard_types": """
WITH RECURSIVE v AS (SELECT t, row_number() OVER (ORDER BY t) AS ord, length(t) AS n FROM (SELECT DISTINCT concat('V:', replace(p_name, ' ', '_'), '#', p_brand) AS t FROM part)),
o AS (SELECT DISTINCT CAST(2000 + p_size * 200 AS BIGINT) AS overhead FROM part),
r AS (
  SELECT overhead, ord, t, 0 AS shard, overhead + n AS used FROM o, v WHERE ord = 1
  UNION ALL
  SELECT r.overhead, v.ord, v.t, r.shard + CASE WHEN r.used + 2 + v.n > 12000 THEN 1 ELSE 0 END, CASE WHEN r.used + 2 + v.n > 12000 THEN r.overhead + v.n ELSE r.used + 2 + v.n END
  FROM r JOIN v ON v.ord = r.ord + 1
)
SELECT overhead, shard, CAST(count(*) AS INTEGER) AS n_types, min_by(t, ord) AS first_type, overhead >= 12000 AS too_long FROM r GROUP BY overhead, shard""",
    "validate_tasks": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing task_id' WHEN doc_id % 5 = 0 THEN 'missing text' END AS reason FROM documents",
    "jobs_without_tasks": f"SELECT job_id, schema FROM ({JOBS}) WHERE n_tasks = 0",
    "require_schema": f"SELECT job_id, 'unknown schema nope; known: coarse, dpv, fine, sti' AS error FROM ({JOBS}) WHERE schema = 'nope'",
    "gate_capability": f"SELECT job_id, schema, endpoint_type, CASE endpoint_type WHEN 'ner' THEN schema <> 'sti' WHEN 'tabular' THEN true ELSE false END AS supported FROM ({JOBS}) WHERE schema <> 'nope'",
    "sample_rows": f"SELECT concat('task-', table_id) AS task_id, table_id, CAST(n - 1 AS INTEGER) AS idx, CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM ({CUSTOMERS}) WHERE n <= 5",
    "column_union": f"SELECT table_id, CASE WHEN c_custkey % 2 = 0 THEN 'c_custkey,c_mktsegment,c_name' ELSE 'c_custkey,c_name' END AS columns FROM ({CUSTOMERS}) WHERE n = 1",
    "table_task_size": f"""
SELECT table_id, CAST(56 + 2 * length(table_id) + sum(length(CAST(c_custkey AS VARCHAR)) + length(name) + 31 + CASE WHEN c_custkey % 2 = 0 THEN length(c_mktsegment) + 20 ELSE 0 END) + 2 * (count(*) - 1) AS BIGINT) AS size
FROM (SELECT c.*, x.c_name AS name FROM ({CUSTOMERS}) c JOIN customer x USING (c_custkey)) WHERE n <= 5 GROUP BY table_id""",
    "vocab_dedupe": "SELECT lang AS schema, min(doc_id) AS ord, source AS type_id FROM documents GROUP BY lang, source",
    "coarse_of": f"""
SELECT doc_id, type_id, CASE WHEN list_contains({_list(COARSE)}, type_id) THEN type_id ELSE {_map_case("type_id", FINE_TO_COARSE.items())} END AS coarse_type_id
FROM (SELECT doc_id, ({_list([*FINE_TO_COARSE, "NER:PERSON", "NER:NONE"])})[doc_id % 12 + 1] AS type_id FROM documents)""",
    "jsonld_vocab": f"""
WITH e AS (
  SELECT {SHORT} AS id, {LABEL_OF} AS label, {IRI} AS iri, p_partkey,
    concat((['2.2/a', '2.2/b', '2.2/c-owl', '2.1/d', '2.2/e', '2.2/f', '2.2/g'])[p_partkey % 7 + 1], lpad(CAST(p_partkey // 100 AS VARCHAR), 9, '0')) AS path
  FROM part WHERE p_partkey % 7 NOT IN (2, 3, 5) AND p_partkey % 6 <> 4 AND p_partkey % 4 <> 3)
SELECT id, label, iri FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path, p_partkey) AS r FROM e) WHERE r = 1""",
    "extract_json": """
SELECT doc_id, (['empty_response', 'no_json', 'bad_json', NULL])[doc_id % 4 + 1] AS error_code,
  CASE WHEN doc_id % 4 = 3 THEN concat('{"a":[', doc_id, ',2],"b":"', source, '"}') END AS value FROM documents""",
    "task_set_check": f"SELECT batch_id, CAST(attempt AS INTEGER) AS attempt, CASE fault WHEN 0 THEN 'missing_task' WHEN 1 THEN 'missing_task,unknown_task' ELSE '' END AS errors FROM ({ATTEMPTS}) WHERE fault <> 6",
    "span_check": "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 'bad_offsets' WHEN doc_id % 5 = 3 THEN CASE WHEN strpos(text, regexp_extract(text, '[A-Za-z]+')) + length(regexp_extract(text, '[A-Za-z]+')) > length(text) THEN 'bad_offsets' ELSE 'text_mismatch' END ELSE '' END AS errors FROM documents",
    "column_check": f"SELECT table_id, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'duplicate_column' ELSE 'column_mismatch' END AS errors FROM ({CUSTOMERS}) WHERE n = 1",
    "canonical_scores": f"""
SELECT doc_id, type_id, max(score) AS score FROM (SELECT doc_id, CASE WHEN type_id = 'NER:OTHER' AND doc_id % 3 = 0 THEN 'NER:PERSON' ELSE type_id END AS type_id, score FROM ({SCORES})) GROUP BY ALL""",
    "score_check": """
SELECT doc_id, (['missing_score_key', 'unknown_score_key', 'negative_score', 'no_positive_score', 'missing_score_key,no_positive_score', 'non_finite_score', '', ''])[doc_id % 8 + 1] AS dense_errors,
  (['', 'unknown_score_key', 'negative_score', 'no_positive_score', 'no_positive_score', 'non_finite_score', '', ''])[doc_id % 8 + 1] AS sparse_errors FROM documents""",
    "select_types": f"""
WITH x AS (SELECT doc_id, i, CASE WHEN i = 3 THEN 'NER:PERSON' WHEN (doc_id + i) % 4 = 0 THEN NULL ELSE ({_list(COARSE)})[(doc_id + i) % 12 + 1] END AS type_id FROM documents, range(4) t(i)),
  f AS (SELECT doc_id, type_id, min(i) AS i FROM x WHERE type_id IS NOT NULL GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, type_id FROM f""",
    "prefilter": f"""
WITH b AS (SELECT source AS job_id, doc_id // 20 AS batch_id, doc_id FROM documents),
  s AS (SELECT DISTINCT job_id, batch_id, doc_id * 5 % 12 AS i FROM b WHERE batch_id % 3 <> 0 AND doc_id % 5 <> 0),
  p AS (SELECT job_id, batch_id, i FROM s UNION ALL SELECT job_id, batch_id, i FROM (SELECT DISTINCT job_id, batch_id FROM b) g, range(12) t(i) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.job_id = g.job_id AND s.batch_id = g.batch_id))
SELECT job_id, batch_id, CAST(row_number() OVER (PARTITION BY job_id, batch_id ORDER BY i) - 1 AS INTEGER) AS idx, ({_list(COARSE)})[i + 1] AS type_id FROM p""",
    "reply_validation": f"SELECT job_id, batch_id, attempt, error_code IS NULL AS is_valid, error_code FROM ({ERRORS})",
    "settle_attempts": f"SELECT job_id, batch_id, attempt, error_code, max(attempt IS NULL) OVER (PARTITION BY job_id) AS job_failed FROM ({SETTLED})",
    "retry_prompt": "SELECT item_id, concat(text, chr(10), chr(10), 'Your last answer was not valid: no_json. Answer with valid JSON only.') AS prompt FROM benchmark",
    "normalize": f"SELECT doc_id, idx, round(p, 9) AS posterior FROM ({POSTERIOR})",
    "normalize_long": f"SELECT doc_id, idx, round(p, 9) AS posterior FROM ({POSTERIOR})",
    "argmax": BEST,
    "argmax_long": BEST,
    "distribution": f"SELECT doc_id, type_id, round(p, 9) AS p FROM ({POSTERIOR})",
    "coarse_rollup": f"""
SELECT doc_id, type_id, CAST(1 AS DOUBLE) AS confidence, {_map_case("type_id", FINE_TO_COARSE.items())} AS coarse_type_id FROM (SELECT doc_id, ({_list(FINE_TO_COARSE)})[doc_id % 10 + 1] AS type_id FROM documents)""",
    "assemble": f"""
SELECT concat('job', (doc_id // 5) % 20) AS job_id, doc_id AS ord, CAST(doc_id AS VARCHAR) AS task_id, CASE WHEN a.text IS NULL THEN 0 ELSE 1 END AS n_entities, a.text AS first_text
FROM documents d LEFT JOIN ({ANNOTATIONS}) a ON a.ord = d.doc_id""",
    "flatten_results": ANNOTATIONS,
    "job_state": f"SELECT job_id, seq, status FROM ({STATE})",
    "job_view": f"""
SELECT c_custkey AS job_id, s.job_id IS NOT NULL AS found, status, CASE WHEN status = 'completed' THEN concat('result-', seq) END AS result, CASE WHEN status = 'failed' THEN concat('error-', seq) END AS error
FROM customer LEFT JOIN ({STATE}) s ON s.job_id = c_custkey""",
    "queue_depth": f"SELECT status, count(*) AS n_jobs FROM ({STATE}) GROUP BY status",
    "fifo": "SELECT event_id AS job_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events",
    "next_jobs": "SELECT event_id AS job_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events QUALIFY position <= 100",
    "admit": "SELECT event_id AS job_id, row_number() OVER (ORDER BY ts, event_id) + 250 <= 1000 AS admitted FROM events",
    "dedupe_submissions": "SELECT user_id AS job_id, event_id AS seq, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "accept_submissions": """
SELECT job_id, seq, accepted FROM (
  SELECT user_id AS job_id, event_id AS seq, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'purchase', true) AS accepted FROM events
) WHERE event_type <> 'purchase'""",
    "admit_with_departures": """
WITH RECURSIVE e AS (SELECT CAST(ts AS DATE) AS q, event_id AS seq, event_type IN ('view', 'click') AS arrives, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT q, i, seq, arrives, CAST(0 AS BIGINT) AS depth FROM e WHERE i = 1
  UNION ALL
  SELECT e.q, e.i, e.seq, e.arrives, CAST(CASE WHEN r.arrives THEN least(r.depth + 1, 5) ELSE greatest(r.depth - 1, 0) END AS BIGINT) FROM r JOIN e ON e.q = r.q AND e.i = r.i + 1
)
SELECT seq, depth AS depth_before, depth < 5 AS admitted FROM r WHERE arrives""",
    "job_outcomes": f"""
SELECT job_id, CASE WHEN count(*) FILTER (attempt IS NULL) > 0 THEN 'failed' ELSE 'completed' END AS status, arg_min(error_code, batch_id) FILTER (attempt IS NULL) AS error FROM ({SETTLED}) GROUP BY job_id""",
    "dispatch": f"SELECT job_id, CASE endpoint_type WHEN 'ner' THEN 'text' WHEN 'tabular' THEN 'table' ELSE 'failed' END AS lane, CASE WHEN endpoint_type = 'other' THEN 'unknown endpoint other' END AS error FROM ({JOBS})",
    "profile_columns": f"""
WITH t AS (SELECT table_id, "column", regexp_replace(value, '^{SPACE}+|{SPACE}+$', '', 'g') AS v FROM ({CELLS}) WHERE value IS NOT NULL),
  c AS (SELECT table_id, "column", {_cell_type('"column"', "v")} AS t, count(*) AS n FROM t GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY table_id, "column") AS total, row_number() OVER (PARTITION BY table_id, "column" ORDER BY n DESC, list_position({_list(STI_TO_COARSE)}, t)) AS r FROM c)
SELECT table_id, "column", t AS type_id, round(n / CAST(total AS DOUBLE), 9) AS confidence, {_map_case("t", STI_TO_COARSE.items())} AS coarse_type_id FROM r WHERE r = 1""",
    "read_tasks": """
SELECT CAST(doc_id AS VARCHAR) AS job_id, 'coarse' AS schema, doc_id % 2 = 0 AS include_scores, o AS ord, CASE o WHEN 0 THEN 'text' ELSE 'source' END AS task_id, CASE o WHEN 0 THEN text ELSE source END AS text
FROM documents, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS o)""",
    "read_replies": "SELECT source AS job_id, doc_id AS batch_id, CAST(doc_id % 3 AS INTEGER) AS attempt, text AS raw_text FROM documents",
    "write_annotations": "SELECT doc_id, n_chars, coalesce(lang, 'none') AS schema FROM documents",
    "write_vocabulary": "SELECT concat('part:', p_partkey) AS id, p_name AS label, CAST(NULL AS VARCHAR) AS iri FROM part",
    "read_vocabulary": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_name AS type_id FROM nation",
    "compacted_job_state": f"SELECT job_id, seq, status FROM ({STATE})",
    "write_job_state": f"SELECT job_id, seq, status FROM ({STATE})",
    "stream_texts": f"""
WITH k AS (SELECT concat(conv_id, '-', turn) AS job_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
  s AS (SELECT job_id, token, sum(length(token) + 1) OVER (PARTITION BY job_id ORDER BY i) - 1 AS stop FROM k)
SELECT job_id, CAST(stop - length(token) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", token AS text, type_id FROM s JOIN ({TERMS}) t ON t.term = s.token""",
    "gazetteer_phrases": f"""
WITH b AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark),
  x AS (SELECT term, ({_list(COARSE)})[min(item_id) % 12 + 1] AS type_id FROM (SELECT item_id, CASE WHEN len(t) >= n THEN array_to_string(t[1:n], ' ') END AS term FROM b, (SELECT unnest([1, 2, 3]) AS n)) WHERE term <> '' GROUP BY term),
  k AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
  s AS (SELECT doc_id, token, lead(token) OVER w AS two, lead(token, 2) OVER w AS three, sum(length(token) + 1) OVER w - 1 - length(token) AS start FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, start, token AS text FROM s UNION ALL SELECT doc_id, start, concat(token, ' ', two) FROM s WHERE two IS NOT NULL UNION ALL SELECT doc_id, start, concat(token, ' ', two, ' ', three) FROM s WHERE three IS NOT NULL)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end", text, type_id, CAST(1 AS DOUBLE) AS score FROM r JOIN x ON x.term = r.text""",
    "profile_wide": f"""
WITH t AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderdate', 'o_orderpriority']) AS "column", regexp_replace(unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]), '^{SPACE}+|{SPACE}+$', '', 'g') AS v FROM orders),
  c AS (SELECT "column", {_cell_type('"column"', "v")} AS t, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, list_position({_list(STI_TO_COARSE)}, t)) AS r FROM c)
SELECT 'orders' AS table_id, "column", t AS type_id, round(n / CAST(total AS DOUBLE), 9) AS confidence, {_map_case("t", STI_TO_COARSE.items())} AS coarse_type_id FROM r WHERE r = 1""",
    "sample_wide_table": """
SELECT 'task-lineitem' AS task_id, 'lineitem' AS table_id, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_linestatus, l_returnflag) - 1 AS INTEGER) AS idx, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_linestatus, l_returnflag
FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_linestatus, l_returnflag LIMIT 5)""",
    "jsonld_rejects": """
WITH p AS (SELECT DISTINCT concat((['2.2/a', '2.2/b', '2.2/c-owl', '2.1/d', '2.2/e', '2.2/f', '2.2/g'])[p_partkey % 7 + 1], lpad(CAST(p_partkey // 100 AS VARCHAR), 9, '0'), '.jsonld') AS path, p_partkey // 100 AS n
  FROM part WHERE p_partkey % 7 NOT IN (2, 3, 5))
SELECT path, (['unparseable', 'double key', 'no entries'])[n % 4 + 1] AS reason FROM p WHERE n % 4 < 3""",
    "gazetteer": f"""
WITH k AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
  s AS (SELECT doc_id, token, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stop FROM k)
SELECT doc_id, CAST(stop - length(token) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", token AS text, type_id, CAST(1 AS DOUBLE) AS score FROM s JOIN ({TERMS}) t ON t.term = s.token""",
}
