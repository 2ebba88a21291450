"""DuckDB SQL with the rows of the queries, written another way where that is possible."""

from __future__ import annotations

import math

from wattline.llm import chat, divergence, mixing, quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _length_of(characters: str, body: str = "body") -> str:
    return f"length(regexp_replace({body}, '{characters}', '', 'g'))"


def op1(max_false_rejection: float = quality_rules.MAX_FALSE_REJECTION, delta: float = quality_rules.DELTA) -> str:
    share = max_false_rejection / len(quality_rules.RULES)
    sums = ", ".join(f"sum(CAST(({c}) AS INT)) AS k_{i}_{j}" for i, j, c in quality_rules.CELLS)
    cells = " UNION ALL ".join(
        f"SELECT stratum, {i} AS rule, {j} AS step, n, k_{i}_{j} AS k FROM sums" for i, j, _ in quality_rules.CELLS)
    rejects = " OR ".join(
        f"(({c}) AND coalesce(cuts[{i} + 1] >= {j}, false))" for i, j, c in quality_rules.CELLS)
    cuts = ", ".join(f"max(step) FILTER (rule = {i})" for i in range(len(quality_rules.RULES)))
    return rf"""
WITH base AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS body, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
scored AS (
  SELECT b.doc_id, stratum, len(words) AS n_words, {_length_of(r'[\x20\x09-\x0D]')} AS word_chars,
         length(body) - {_length_of(r'[#*$%&|<>]')} AS n_symbols, length(body) - {_length_of('[!?]')} AS n_marks,
         length(body) - {_length_of('[A-Z]')} AS n_capitals, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM scored),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
sums AS (SELECT stratum, count(*) AS n, {sums} FROM judged JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
cells AS ({cells}),
tails AS (
  SELECT stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
         + j * ln({share}) + (n - j) * ln(1 - {share}))) AS tail
  FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT) + 1)) AS j FROM cells WHERE k <= n * {share}) GROUP BY ALL),
cuts AS (
  SELECT stratum, [{cuts}] AS cuts FROM tails
  WHERE tail <= {delta} / ((SELECT count(*) FROM sums) * {len(quality_rules.CELLS)}) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({rejects}) AS kept
FROM judged j LEFT JOIN cuts c ON j.stratum IS NOT DISTINCT FROM c.stratum"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2() -> str:
    def extra(column: str) -> str:
        """Characters that escaping adds: one for a backslash, two for each control string in turn."""
        out = f"replace({column}, '\\', '\\z')"
        for control, mark in zip(chat.CONTROLS, chat.MARKS, strict=True):
            out = f"replace({out}, {_quote(control)}, {_quote(control[0] + chr(92) + mark + control[1:])})"
        return out

    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(replace({extra('role')}, chr(10), '\n')) + length({extra('text')}) + 13) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said"""


def op4(weights=mixing.WEIGHTS, scale: float = mixing.SCALE, most: int = mixing.MOST, seed: str = "mix") -> str:
    """The targets by repeated sharing of the excess, the selection by a sorted running sum."""
    listed = "[" + ", ".join(f"CAST({w} AS DOUBLE)" for w in weights) + "]"
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * {float(most)} AS cap,
         {listed}[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER () * CAST({scale} AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM totals WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT max(level) FROM filled WHERE cap >= level * weight)), cap)
         AS target FROM filled),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM aims),
budgets AS (SELECT *, CAST(floor(target - passes * source_size) AS BIGINT) AS budget FROM passes),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken
FROM run"""


def op6(least: int = 100) -> str:
    return f"""
WITH keyed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
held AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM keyed),
judged AS (SELECT *, payload_bytes >= {least} AND lead IS NOT NULL AND lead IS DISTINCT FROM page_id AS again FROM held)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN lead END AS refers_to FROM judged"""


def op11(least_docs: int = divergence.LEAST_DOCS, top: int = divergence.TOP) -> str:
    """Every document is cut by itself, and shares of all sources and kept terms are laid out in full."""
    share = "1 + CAST(1000000000 AS HUGEINT) * ({0} + 2) // ({1} + 2 * v)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(body, '{divergence.TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
l AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, kept.term, coalesce(n, 0) AS n, {share.format("coalesce(n, 0)", "s.total")} AS p,
         {share.format("whole", "l.total")} AS q
  FROM s JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
more AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
  FROM every
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
    FROM more) WHERE rank <= {top})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""
