"""DuckDB SQL for those registered queries that SQL can express."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op10_line_dedup"] = r"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
lines AS (
  SELECT DISTINCT source, text, trim(line, concat(' ', chr(9), chr(13))) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)
),
bad AS (
  SELECT source, list(line) AS known
  FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line) JOIN totals USING (source)
  WHERE n >= 5 AND n > total * CAST(0.1 AS DOUBLE)
  GROUP BY source
),
judged AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS all_lines,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(known, []), trim(x, concat(' ', chr(9), chr(13))))) AS kept
  FROM documents LEFT JOIN bad USING (source)
),
settled AS (
  SELECT doc_id, text, all_lines,
         CASE WHEN len(list_filter(kept, lambda x: trim(x, concat(' ', chr(9), chr(13))) <> '')) > 0 THEN kept ELSE all_lines END AS kept
  FROM judged
)
SELECT doc_id,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(all_lines) - len(kept) END AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(array_to_string(kept, chr(10))) END AS kept_sha256
FROM settled
"""

STATEMENTS["op11_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h
  FROM documents
),
u AS (
  SELECT *, [CAST(CAST(concat('0x', substr(h, 8 * k + 1, 8)) AS UBIGINT) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS x FROM t
),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90
                 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b
  FROM u
),
p AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
                        ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

STATEMENTS["op12_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]'
),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
e AS (
  SELECT *, regexp_replace(role, '(<)(\\*(?:s>|/s>))|(\[)(\\*(?:INST\]|/INST\]))', '\1\3\\\2\4', 'g') AS safe_role,
         regexp_replace(text, '(<)(\\*(?:s>|/s>))|(\[)(\\*(?:INST\]|/INST\]))', '\1\3\\\2\4', 'g') AS safe_text
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(6 + length(safe_role) + 7 + length(safe_text) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

STATEMENTS["op13_lexical_search"] = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
asked AS (
  SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark
),
cut AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM lowered),
totals AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM cut),
wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked) GROUP BY ALL
),
counted AS (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM cut)
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counted, totals GROUP BY term, docs
),
values_of AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS value
  FROM counted JOIN weights USING (term), totals
),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * value) AS BIGINT) AS score
  FROM wanted JOIN values_of USING (term) GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""

def statements() -> dict[str, str]:
    return dict(STATEMENTS)
