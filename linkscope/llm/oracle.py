"""DuckDB SQL of the operators that SQL can express; columns, names and types as their queries give them.

The rules' numbers and words are filled in from the operators' own settings; the rules themselves are written out anew.
"""

from __future__ import annotations

import re

from linkscope.llm import quality
from linkscope.llm.chat import ChatTemplate

SPACE = "[\\x20\\t-\\r]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _count(chars: str, of: str) -> str:
    return f"length(regexp_replace({of}, '[^{chars}]', '', 'g'))"


def quality_rules() -> str:
    r = quality.QualityRules()
    endings = ", ".join(map(_text, quality.ENDINGS))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spoken AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\t-\\r]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\\x20\\t-\\r]+'), 1) AS i FROM docs),
windows AS (SELECT doc_id, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM spoken WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS step(k) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM spoken GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
bared AS (SELECT doc_id, line, trim(regexp_replace(line, '{SPACE}+', ' ', 'g')) AS bare FROM split WHERE regexp_matches(line, '[^\\x20\\t-\\r]')),
sized AS (SELECT *, len(string_split(bare, ' ')) AS n FROM bared),
seen AS (SELECT *, length(bare) - n + 1 AS visible FROM sized),
judged AS (
  SELECT doc_id, line, visible,
    NOT (n < {r.min_line_words}
      OR (n < {r.min_unended_words} AND right(bare, 1) NOT IN ({endings}))
      OR {_count(re.escape(quality.SYMBOLS), "bare")} > CAST({r.max_symbols_per_visible!r} AS DOUBLE) * visible
      OR {_count(quality.NAVIGATION, "bare")} > CAST({r.max_navigation_per_word!r} AS DOUBLE) * n
      OR {_count("!?", "bare")} > CAST({r.max_exclaims_per_word!r} AS DOUBLE) * n
      OR {_count("\\p{Lu}", "bare")} > greatest(8.0, CAST({r.max_upper_share!r} AS DOUBLE) * visible)
      OR (n <= {r.max_boilerplate_words} AND regexp_matches(bare, '(?i){"|".join(quality.BOILERPLATE)}'))) AS stays
  FROM seen),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays) AS n_lines_kept, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(visible) FILTER (stays), 0) AS visible_kept FROM judged GROUP BY doc_id),
figures AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, {_count(re.escape(quality.SYMBOLS), "text")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_kept, 0) AS n_lines_kept, coalesce(visible_kept, 0) AS visible_kept
  FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
based AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM figures)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN word_chars > 0 THEN 1 - CAST(visible_kept AS DOUBLE) / word_chars ELSE 1.0 END <= CAST({r.max_lost!r} AS DOUBLE) AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines_kept AS BIGINT) AS n_lines_kept
FROM based"""


def chat() -> str:
    t = ChatTemplate()
    controls = _text(t.controls.pattern)
    escaped = lambda x: f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all(replace({x}, '\\', '\\\\'), {controls})))"
    marks = " ".join(f"WHEN {_text(name)} THEN {len(r.before) + len(r.after)}" for name, r in t.roles.items())
    other = len(t.other.before) + len(t.named) + len(t.other.after)
    learnt = ", ".join(_text(name) for name, r in t.roles.items() if r.learnt)
    after = lambda r: " OR ".join("before IS NULL" if f == "START" else f"before = {_text(f)}" for f in r.follows)
    follows = " ".join(f"WHEN {_text(name)} THEN coalesce({after(r)}, false)" for name, r in t.roles.items())
    ends = ", ".join(map(_text, t.ends))
    said = _text("</s>[INST] ok [/INST]")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
placed AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before, lead(role) OVER w AS following FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learnt})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role IN ({learnt})), '')) AS loss_sha256,
  CAST(sum({escaped("text")} + CASE role {marks} ELSE {other} + {escaped("role")} END) AS BIGINT) AS formatted_chars,
  bool_and(CASE role {follows} ELSE false END AND (following IS NOT NULL OR role IN ({ends}))) AS valid
FROM placed GROUP BY conv_id"""


WARC = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS original FROM payloads)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM first"""

NEIGHBOURS = """
WITH sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in CAST(embedding AS DOUBLE[]) if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in CAST(embedding AS DOUBLE[]) if x <> 0]) > 0),
squared AS (SELECT q.vec_id AS query_id, s.vec_id, [(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(q.v, s.v)] AS x FROM (SELECT DISTINCT vec_id, v FROM sound WHERE vec_id % 100 = 0) q JOIN sound s ON s.vec_id <> q.vec_id AND len(s.v) = len(q.v)),
-- Squares are added as numpy adds up to 128 numbers: eight sums of every eighth, then these in pairs.
eight AS (SELECT query_id, vec_id, [list_sum([x[i] for i in range(k, len(x) + 1, 8)]) for k in range(1, 9)] AS r FROM squared),
met AS (SELECT query_id, vec_id, sqrt(((r[1] + r[2]) + (r[3] + r[4])) + ((r[5] + r[6]) + (r[7] + r[8]))) AS score FROM eight),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM met)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules(), "op2_chat": chat(), "op4_warc": WARC, "op10_vantage_neighbours": NEIGHBOURS}
