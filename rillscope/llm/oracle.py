"""DuckDB SQL of the text operators that SQL can express."""

from __future__ import annotations

from .divergence import LOWER, MIN_DOCS, TOP, UPPER
from .quality_rules import ALPHA, DELTA, LENGTH_CLASSES, RULES, STRATA, WINDOW


def _statistic() -> str:
    return "CASE rule " + " ".join(f"WHEN '{r}' THEN {s}" for r, (s, _) in RULES.items()) + " END"


def quality_rules_sql() -> str:
    """Features, safe cutoffs and verdicts from ``documents`` and ``labels``."""
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts))
    p = ALPHA / len(RULES)
    classes = " + ".join(f"(n_words >= {n})::INT" for n in LENGTH_CLASSES)
    return rf"""WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY rid),
feat AS (
  SELECT w.rid, doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_marks FROM w LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce('=' || lang, '-') || '/' || ({classes})::VARCHAR AS stratum FROM feat),
held AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1)),
grid(rule, step, cutoff) AS (VALUES {grid}),
tally AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER ({_statistic()} > cutoff) AS k FROM held CROSS JOIN grid GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p})))) END
    <= {DELTA} / ({len(RULES)} * greatest({STRATA}, (SELECT count(DISTINCT stratum) FROM held))) AS safe FROM tally),
ends AS (SELECT stratum, rule, coalesce(min(step) FILTER (NOT safe), 1000) AS last FROM tested GROUP BY ALL),
best AS (SELECT t.stratum, t.rule, arg_max(t.cutoff, t.step) AS cutoff FROM tested t JOIN ends e ON e.stratum = t.stratum AND e.rule = t.rule AND t.step < e.last GROUP BY ALL),
hit AS (SELECT DISTINCT rid FROM f JOIN best USING (stratum) WHERE {_statistic()} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.rid IS NULL AS kept, stratum FROM f LEFT JOIN hit USING (rid)"""


def exact_dedup_sql() -> str:
    """Groups of equal normalised texts."""
    return r"""SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents) WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)"""


def divergence_sql() -> str:
    """Shares of kept terms by group and language, their divergences and ranks."""
    share = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT rid, lang, source, unnest(ts) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
cnt AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM t),
l AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(cnt.c), 0) AS n FROM g LEFT JOIN cnt USING (lang, source) GROUP BY g.lang, g.source),
sh AS (SELECT gn.lang, gn.source, kept.term, coalesce(cnt.c, 0) AS c, {share.format("coalesce(cnt.c, 0)", "gn.n")} AS p, {share.format("kept.c", "l.n")} AS q
  FROM gn JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = gn.lang AND cnt.source = gn.source AND cnt.term = kept.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM sh a JOIN sh b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM sh WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= {TOP}"""
