"""SQL, for an engine other than Spark, of the queries that SQL can express."""

from __future__ import annotations

from .line_quality import LineLimits
from .url_rules import RULES, MiningLimits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"
_limits = LineLimits()

LINE_FREQUENCY = f"""WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS words FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS often FROM windows), range(0, 5) t(k) WHERE often > 1 GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, host, text, line, regexp_extract_all(translate(line, '{UPPER}123456789', '{LOWER}000000000'), {_WORD}) AS lw FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
keyed AS (SELECT doc_id, host, text, array_to_string(lw, ' ') AS key, sum(len(lw)) AS n FROM lines GROUP BY ALL),
common AS (SELECT host, key, min(doc_id) AS first_doc FROM keyed GROUP BY host, key HAVING count(DISTINCT text) > {_limits.max_documents}),
lost AS (SELECT k.doc_id, sum(k.n) AS n FROM keyed k JOIN common c ON k.host = c.host AND k.key = c.key WHERE k.doc_id <> c.first_doc GROUP BY k.doc_id),
counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(i.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN inside i USING (doc_id) LEFT JOIN dups u USING (doc_id) LEFT JOIN lost l USING (doc_id)),
judged AS (SELECT *, n_words < {_limits.min_words} OR 100 * n_repeat_words > {_limits.max_repeat_percent} * n_words AS base_failed, n_words - n_removed_words AS rest FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rest >= n_words * CAST({_limits.min_left_share} AS DOUBLE) AND rest >= {_limits.min_words} AS kept, n_removed_words FROM judged"""

METRIC_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_WORD}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reached(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reached GROUP BY id) r ON r.id = d.doc_id"""


def _fixed(column: str) -> str:
    """The longest rule that fits, or its verdict."""
    cases = []
    for action, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule if column == 'rule' else action}'")
    return f"CASE {' '.join(cases)} END"


_mining = MiningLimits()
_TOKENS = r"""regexp_extract_all(path, '[^/]+') AS segments, list_transform(segments, lambda x: regexp_replace(x, '[0-9]+', '0', 'g')) AS parts, lower(host) AS h, string_split(h, '.') AS labels,
  list_sort(list_distinct(list_transform(list_filter(string_split(substr(regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1), 2), '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)))) AS keys,
  CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN [] ELSE list_sort(list_filter(['host:' || h, 'top:' || labels[-1], 'depth:' || least(len(parts), 9), CASE WHEN len(labels) > 1 THEN 'domain:' || labels[-2] || '.' || labels[-1] END,
    CASE WHEN len(labels) > 1 THEN 'label:' || labels[1] END, CASE WHEN len(parts) > 0 THEN 'first:' || parts[1] END, CASE WHEN contains(parts[-1], '.') THEN 'ext:' || string_split(parts[-1], '.')[-1] END,
    CASE WHEN len(keys) > 0 THEN 'keys:' || array_to_string(keys, '&') END, CASE WHEN contains(rest, '#') THEN 'fragment' END], lambda x: x IS NOT NULL)) END AS tokens"""

URL_RULES = f"""WITH u AS (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, {_TOKENS} FROM p),
labelled AS (SELECT tokens, quality = 0 OR toxic = 1 AS block FROM t JOIN labels l ON l.doc_id = t.page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
base AS (SELECT count(*) AS n, count_if(block) AS bad FROM labelled),
subsets AS (SELECT list_filter(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN tokens[i] END), lambda x: x IS NOT NULL) AS part, block FROM (SELECT tokens, block, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS mask FROM labelled)),
counted AS (SELECT part, count(*) AS m, count_if(block) AS bad FROM subsets GROUP BY part),
sides AS (SELECT part, true AS block, m, c.bad AS urls, b.bad::DOUBLE / b.n AS rate FROM counted c, base b WHERE 0 < b.bad AND b.bad < b.n UNION ALL SELECT part, false, m, m - c.bad, 1 - b.bad::DOUBLE / b.n FROM counted c, base b WHERE 0 < b.bad AND b.bad < b.n),
scored AS (SELECT part, block, urls, rate, m, urls::DOUBLE / m AS c, (c - rate) / (1 - rate) AS certainty FROM sides WHERE urls >= {_mining.min_urls}),
rules AS (SELECT part, block, urls, certainty FROM scored WHERE certainty >= {_mining.min_certainty}::DOUBLE AND (c + {_mining.errors**2}::DOUBLE / (2 * m) - {_mining.errors}::DOUBLE * sqrt(c * (1 - c) / m + {_mining.errors**2}::DOUBLE / (4 * m * m))) / (1 + {_mining.errors**2}::DOUBLE / m) > rate),
shorter AS (SELECT part, block, certainty, list_filter(part, lambda x: x <> gone) AS wider FROM (SELECT *, unnest(part) AS gone FROM rules)),
covered AS (SELECT DISTINCT s.part, s.block FROM shorter s JOIN rules r ON r.part = s.wider AND r.block = s.block AND r.certainty >= s.certainty),
kept AS (SELECT r.* FROM rules r LEFT JOIN covered c ON c.part = r.part AND c.block = r.block WHERE c.block IS NULL),
mined AS (SELECT page_id, url, arg_min(k.block, (-certainty, -urls, part, k.block)) AS block FROM t JOIN kept k ON list_has_all(tokens, part) GROUP BY ALL)
SELECT p.page_id, host, path, {_fixed('rule')} AS rule, coalesce({_fixed('verdict')}, CASE WHEN m.block THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN mined m ON m.page_id = p.page_id AND m.url = p.url"""
