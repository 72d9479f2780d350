"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from stratapanel.llm.rules import HOST_LIMIT

_RULES = {
    "too_short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def _host_rules() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS f_{r}" for r, c in _RULES.items())
    prior = ", ".join(
        f"avg(CAST(f_{r} AS DOUBLE) / docs) AS m_{r}, var_pop(CAST(f_{r} AS DOUBLE) / docs) AS v_{r}" for r in _RULES
    )
    weight = ", ".join(f"CASE WHEN v_{r} > 0 THEN greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0) END AS c_{r}" for r in _RULES)
    above = " OR ".join(
        f"CASE WHEN v_{r} > 0 THEN (f_{r} + c_{r} * m_{r}) / (docs + c_{r}) ELSE m_{r} END > {HOST_LIMIT}" for r in _RULES
    )
    base = f"({_RULES['too_short']} OR {_RULES['repeats']})"
    fails = "(" + " OR ".join(_RULES.values()) + ")"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (
  SELECT r, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS g
  FROM x WINDOW s AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), chars AS (SELECT r, count(*) AS n, sum(length(word)) AS c FROM x GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS u
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.doc_id, d.source, CAST(coalesce(chars.n, 0) AS BIGINT) AS n_words,
    CAST(coalesce(chars.c, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n - lines.u, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN chars USING (r) LEFT JOIN lines USING (r) LEFT JOIN cov USING (r)
), hosts AS (SELECT source, count(*) AS docs, {counts} FROM m GROUP BY source),
prior AS (SELECT {prior} FROM hosts),
weight AS (SELECT *, {weight} FROM prior),
verdict AS (SELECT source, ({above}) AS distrusted FROM hosts, weight)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
  {base} AS base_failed, distrusted AS host_distrusted, NOT {base} AND NOT (distrusted AND {fails}) AS kept
FROM m JOIN verdict ON m.source IS NOT DISTINCT FROM verdict.source
"""


_SNAPSHOTS = """
WITH rows_ AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS number
  FROM rows_ WHERE conv_id IS NOT NULL -- the table has no turns without one
), p AS (
  SELECT conv_id, number,
    string_agg(CASE WHEN role IS NULL THEN 'n' ELSE 'r' || role END || chr(30)
               || CASE WHEN text IS NULL THEN 'n' ELSE 't' || text END, chr(31)) OVER w AS prefix,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER w AS said
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY number)
), whole AS (
  SELECT conv_id, number, prefix, said FROM p QUALIFY number = max(number) OVER (PARTITION BY conv_id)
), proper AS (
  SELECT DISTINCT p.number, p.prefix FROM p JOIN whole USING (conv_id) WHERE p.number < whole.number
)
SELECT min(conv_id) AS conv_id, CAST(number AS INT) AS n_turns, count(*) AS copies, any_value(said) AS rendered
FROM whole WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.number = whole.number AND proper.prefix = whole.prefix)
GROUP BY number, prefix
"""

_RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM d WHERE len(ts) > 0
), tf AS (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, s GROUP BY term
), parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))) AS part
  FROM tf JOIN w USING (term), s
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN parts USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {"op6_snapshot_collapse": _SNAPSHOTS, "op7_host_rules": _host_rules(), "op11_ball_tree_search": _RANKED}
