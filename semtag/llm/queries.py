"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import re

from .ann import op1_search
from .chat import BODY, CONTROL, END, START, op6_chat
from .extraction import op7_extract
from .langid import op4_language
from .lm import op3_score
from .mixing import op5_mix
from .neardup import op8_near_duplicates
from .packing import op9_pack
from .pii import op13_personal_data
from .quality import op2_quality
from .sharding import op10_shard
from .variants import op11_variants
from .whitening import op12_whiten

QUERIES = {
    "op1_search": op1_search,
    "op2_quality": op2_quality,
    "op3_score": op3_score,
    "op4_language": op4_language,
    "op5_mix": op5_mix,
    "op6_chat": op6_chat,
    "op7_extract": op7_extract,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_pack": op9_pack,
    "op10_shard": op10_shard,
    "op11_variants": op11_variants,
    "op12_whiten": op12_whiten,
    "op13_personal_data": op13_personal_data,
}
#: What the template escapes by one more character: a backslash, or the first character of a control string.
_ESCAPED = r"\\|" + "|".join(re.escape(c) for c in CONTROL)
_TEMPLATE = len(START + BODY + END)
ORACLE_SQL = {
    "op6_chat": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, concat(role, chr(10), text, chr(10)) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
         {_TEMPLATE} + length(role) + length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) + len(regexp_extract_all(role, '{_ESCAPED}|\n')) AS size
  FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
