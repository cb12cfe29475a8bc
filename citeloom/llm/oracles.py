"""DuckDB SQL for the corpus queries that SQL can express.

The others rest on sketches, tokenisers, trained models, random rounding or files; their tests compare
them with brute force, round trips or held-out accuracy.
"""

from citeloom.llm.quality import BOILERPLATE, NAVIGATION, Rules

_R = Rules()
_W = r"[^\x20\x09-\x0D]+"


def _phrases(names: tuple[str, ...]) -> str:
    return "|".join(names)


def _count(line: str, chars: str) -> str:
    return f"length(regexp_replace({line}, '[^{chars}]', '', 'g'))"


_LINES = f"""SELECT doc_id, rid, i, line, w, len(w) AS n, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again
  FROM (SELECT doc_id, rid, i, line, regexp_extract_all(line, '{_W}') AS w
    FROM (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t)) WHERE len(w) > 0"""

_FAILED = f"""CASE WHEN again THEN true
  WHEN 100 * {_count("line", "|")} > {_R.bars_per_100_words} * n THEN true
  WHEN 100 * {_count("line", "#*$%&<>")} > {_R.symbols_per_100_words} * n THEN true
  WHEN n >= {_R.least_words} AND 100 * len(list_filter(range(1, n), lambda k: w[k] = w[k + 1])) > {_R.stutter_percent} * n THEN true
  WHEN n >= {_R.least_words} AND 100 * ((length(line) - length(replace(line, '!!', ''))) // 2) > {_R.exclaimed_percent} * n THEN true
  WHEN n >= {_R.least_words} AND {_count("line", "A-Z")} > 0 AND 100 * {_count("line", "A-Z")} > {_R.shouted_percent} * {_count("line", "A-Za-z")} THEN true
  WHEN n <= {_R.short_line_words} AND regexp_matches(lower(line), '{_phrases(NAVIGATION)}') THEN true
  WHEN regexp_matches(lower(line), '{_phrases(BOILERPLATE)}') THEN true ELSE false END"""

OP3 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
  base AS (SELECT doc_id, rid, text, regexp_extract_all(text, '{_W}') AS w FROM t),
  lines AS ({_LINES}),
  judged AS (SELECT rid, count(*) FILTER (WHERE again) AS dup, count(*) FILTER (WHERE failed) AS removed, coalesce(sum(n) FILTER (WHERE failed), 0) AS lost FROM (SELECT *, {_FAILED} AS failed FROM lines) GROUP BY rid),
  grams AS (SELECT rid, k, concat_ws(' ', w[k], w[k + 1], w[k + 2], w[k + 3], w[k + 4]) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS k FROM base WHERE len(w) > 5)),
  twice AS (SELECT rid, k FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
  covered AS (SELECT rid, count(DISTINCT k + d) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(d) GROUP BY rid),
  f AS (SELECT b.doc_id, len(b.w) AS n_words, length(regexp_replace(b.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, {_count("b.text", "#*$%&|<>")} AS n_symbols, coalesce(j.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(j.removed, 0) AS lines_removed, coalesce(j.lost, 0) AS lost
    FROM base b LEFT JOIN judged j ON b.rid = j.rid LEFT JOIN covered c ON b.rid = c.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_R.base_least_words} OR 100 * n_repeat_words > {_R.base_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.base_least_words} OR 100 * n_repeat_words > {_R.base_repeat_percent} * n_words) AND 100 * lost <= {_R.most_lost_percent} * n_words AS kept, lines_removed FROM f"""

SQL: dict[str, str] = {"op3_quality": OP3}
