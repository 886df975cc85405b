"""SQL of the registered queries for an engine other than Spark, from the same data (chains, packs, limits)."""

from __future__ import annotations

from ..functions import names as N
from ..functions.script import projected_sql
from ..functions.text import ANY_CLOSING, ANY_OPENING, PUNCTUATION, QUOTES
from ..operators import lines as L
from ..operators import rules as R


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


KANA = "぀-ゟ゠-ヿ"
CJK = "一-鿿㐀-䶿豈-﫿"

RAW = f"""parts AS (SELECT doc_id, string_split({projected_sql('text')}, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM parts)"""

SCANNED = f"""split AS (SELECT doc_id, list_filter(list_transform(string_split({projected_sql('text')}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS p FROM documents),
scanned AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM split)"""


def line_type(line: str, b: L.Boundaries) -> str:
    s = trim(line)
    fits = lambda ps: " OR ".join(f"regexp_matches({s}, {q(p)})" for p in ps) or "false"
    return f"CASE WHEN {s} = '' THEN 'blank' WHEN {fits(b.metadata)} THEN 'metadata' WHEN {fits(b.scene_break)} THEN 'scene_break' WHEN {fits(b.chapter_heading)} THEN 'chapter_heading' WHEN {s}[1] IN ('「', '『') THEN 'dialogue' ELSE 'narration' END"


def features(line: str) -> str:
    pairs = (("name_hint", L.NAME_HINT), ("katakana_long", L.KATAKANA_LONG), ("kanji", L.KANJI_NAME), ("time_anchor", L.TIME_ANCHOR), ("speech_verb", L.SPEECH_VERB), ("has_quote", "[「『]"))
    return f"{trim(line)}[1] IN ('「', '『') AS dialogue, " + ", ".join(f"regexp_matches({line}, {q(p)}) AS {n}" for n, p in pairs)


_pack = R.SMALL_PACK
_kw = ", ".join(f"({q(c.id)}, {q(w)}, {x})" for c in _pack.categories for w, x in c.keywords)
_cat = ", ".join(f"({q(c.id)}, {q(c.label)}, {c.priority}, {str(bool(c.actions.get('reset_context'))).lower()}, {str(bool(c.actions.get('needs_glossary'))).lower()})" for c in _pack.categories)
_spoken = " ".join(f"WHEN {trim('line')}[1] = '{a}' AND contains({trim('line')}, '{b}') AND length({trim('line')}) - instr(reverse({trim('line')}), '{b}') > 1 THEN length({trim('line')}) - instr(reverse({trim('line')}), '{b}') - 1" for a, b in ("「」", "『』"))
DETECTED = f"""{RAW},
kw(category, word, weight) AS (VALUES {_kw}), cat(id, label, priority, resets, glossaries) AS (VALUES {_cat}),
typed AS (SELECT *, {line_type('line', _pack.boundaries)} AS line_type FROM lines),
placed AS (SELECT doc_id, line_no, line, line_type, category, word, weight, unnest(list_filter(range(1, length(line) + 1), lambda i: substr(line, i, length(word)) = word)) AS pos
  FROM typed JOIN kw ON contains(line, word) WHERE line_type IN ('dialogue', 'narration')),
longest AS (SELECT doc_id, line_no, pos, max(length(word)) AS n FROM placed GROUP BY ALL),
tops AS (SELECT DISTINCT p.doc_id, p.line_no, p.pos, p.category FROM placed p JOIN longest l ON p.doc_id = l.doc_id AND p.line_no = l.line_no AND p.pos = l.pos AND length(p.word) = l.n),
kept AS (SELECT p.* FROM placed p JOIN longest l USING (doc_id, line_no, pos) LEFT JOIN tops t ON p.doc_id = t.doc_id AND p.line_no = t.line_no AND p.pos = t.pos AND p.category = t.category WHERE length(p.word) = l.n OR t.category IS NULL),
once AS (SELECT doc_id, line_no, line, line_type, category, word, any_value(weight) AS weight, min(pos) AS pos FROM kept WHERE line_type = 'dialogue' OR category <> '{R.REPLY}' GROUP BY ALL),
weighed AS (SELECT doc_id, line_no, category, word, CASE WHEN category IN ({', '.join(map(q, sorted(R.DISCOURSE)))}) AND strlen(substr(line, 1, pos - 1)) - (strlen(line) - strlen(ltrim(line, '{R.LEADING}'))) BETWEEN 0 AND {R.INITIAL_BYTES - 1}
  THEN floor(weight * {R.INITIAL_FACTOR} * 10 + 0.5) / 10 ELSE weight END AS weight FROM once),
replies AS (SELECT doc_id, line_no, '{R.REPLY}' AS category, '(short_dialogue)' AS word, {R.REPLY_WEIGHT} AS weight FROM typed t
  WHERE line_type = 'dialogue' AND CASE {_spoken} ELSE 99 END <= {R.SHORT_REPLY} AND NOT EXISTS (SELECT 1 FROM weighed w WHERE w.doc_id = t.doc_id AND w.line_no = t.line_no AND w.category = '{R.REPLY}')),
matches AS (SELECT * FROM weighed UNION ALL SELECT * FROM replies),
scores AS (SELECT doc_id, line_no, category, least(sum(CAST(round(weight * 10) AS BIGINT)), 800) AS tenths, count(*) AS n FROM matches GROUP BY ALL),
best AS (SELECT doc_id, line_no, label, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY priority DESC, tenths DESC, category DESC) AS r, bool_or(resets) OVER w AS resets, bool_or(glossaries) OVER w AS glossaries, sum(n) OVER w AS n
  FROM scores JOIN cat ON id = category WINDOW w AS (PARTITION BY doc_id, line_no)),
detected AS (SELECT t.doc_id, t.line_no, t.line, t.line_type, b.label AS dominant, coalesce(b.resets, t.line_type IN ('scene_break', 'chapter_heading')) AS reset, coalesce(b.glossaries, false) AS glossary, CAST(coalesce(b.n, 0) AS BIGINT) AS n_matches
  FROM typed t LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON t.doc_id = b.doc_id AND t.line_no = b.line_no)"""

SEGMENTS = f"""{DETECTED},
segments AS (SELECT *, coalesce(max(CASE WHEN reset THEN line_no + 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS segment_start FROM detected)"""


def needs(size: int) -> str:
    has = lambda c: f"coalesce(list_contains(m.cats, '{c}'), false)"
    return f"""{SEGMENTS},
cats AS (SELECT doc_id, line_no, list(DISTINCT category) AS cats FROM matches GROUP BY ALL),
flags AS (SELECT s.*, CAST(floor((s.line_no - 1) / {size}) AS BIGINT) AS batch_id, s.line_type = 'dialogue' OR {has('quote_and_speech_verbs')} AS n_dialogue, contains(coalesce(dominant, ''), 'antecedent') AS n_antecedent,
  contains(coalesce(dominant, ''), 'explicit anchor') AS n_anchor, {has('hearsay_and_source')} AS n_source, {has('benefactive_construction')} AS n_relation FROM segments s LEFT JOIN cats m ON s.doc_id = m.doc_id AND s.line_no = m.line_no),
needs AS (SELECT doc_id, batch_id, min(line_no) AS target_start, max(line_no) AS target_end, arg_min(segment_start, line_no) AS segment_start, bool_or(n_dialogue) AS need_dialogue_prev, bool_or(n_antecedent) AS need_antecedent, bool_or(n_anchor) AS need_anchor,
  bool_or(n_source) AS need_source, bool_or(n_relation) AS need_relationship FROM flags GROUP BY ALL)"""


def selected(size: int, window: int, k: int) -> str:
    near = lambda r: f"line_no >= greatest(low, high - {r})"
    terms = [
        ("line_no >= greatest(low, target_start - 2)", 0.6), ("need_dialogue_prev AND coalesce(line_no = nearest, false)", 3.0), (f"need_dialogue_prev AND dialogue AND {near(6)}", 1.0), (f"need_antecedent AND name_hint AND {near(20)}", 2.2),
        (f"need_antecedent AND katakana_long AND {near(20)}", 1.2), (f"(need_anchor OR need_source) AND speech_verb AND {near(25)}", 1.6), (f"(need_anchor OR need_source) AND time_anchor AND {near(25)}", 1.4),
        (f"need_relationship AND name_hint AND {near(15)}", 1.0), ("line_no = target_start - 1", 2.0),
    ]
    score = "1.0::DOUBLE / greatest(target_start - line_no, 1)" + "".join(f" + CASE WHEN {c} THEN {x}::DOUBLE ELSE 0.0::DOUBLE END" for c, x in terms)
    return f"""{needs(size)},
featured AS (SELECT doc_id, line_no, line, {features('line')} FROM lines),
ranges AS (SELECT *, greatest(segment_start, target_start - {window}) AS low, target_start - 1 AS high FROM needs),
met AS (SELECT r.*, f.line_no, f.line, f.dialogue, f.name_hint, f.katakana_long, f.time_anchor, f.speech_verb, max(CASE WHEN f.dialogue THEN f.line_no END) OVER (PARTITION BY r.doc_id, r.batch_id) AS nearest
  FROM ranges r JOIN featured f ON r.doc_id = f.doc_id AND f.line_no BETWEEN r.low AND r.high),
ranked AS (SELECT doc_id, batch_id, line_no, line, {score} AS score FROM met),
selected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, batch_id ORDER BY score DESC, line_no DESC) AS r FROM ranked) WHERE r <= {k})"""


PAIRS = """base AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS dst FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
pairs AS (SELECT conv_id, turn, 0 AS variant, src, dst FROM base UNION ALL SELECT conv_id, turn, 1, src, left(dst, CAST(floor(length(dst) / 3) AS BIGINT)) FROM base
  UNION ALL SELECT conv_id, turn, 2, src, CASE WHEN conv_id % 3 = 0 THEN lower(src) ELSE src END FROM base UNION ALL SELECT conv_id, turn, 3, src, CASE WHEN conv_id % 5 = 0 THEN '' ELSE repeat(left(src, 3), 17) || 'x' END FROM base
  UNION ALL SELECT conv_id, turn, 4, '「' || src || '？」第１２話', '"' || left(src, 40) || '?"' FROM base)"""


def repeated(x: str, least: int, most: int, times: int) -> str:
    one = [f"len(list_filter(range(1, length({x}) - {n * times} + 1), lambda i: repeat(substr({x}, i, {n}), {times}) = substr({x}, i, {n * times}))) > 0" for n in range(least, most + 1)]
    return "(" + " OR ".join(one) + ")"


def jaccard(a: str, b: str) -> str:
    x, y = (f"list_filter(list_distinct(string_split({c}, '')), lambda z: z <> '')" for c in (a, b))
    return f"coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0)"


def half(x: str) -> str:
    return f"translate({x}, '０１２３４５６７８９', '0123456789')"


def checks(source: str, soft: bool = True) -> str:
    """Subqueries from a relation of pairs to ``checked`` (with error), with all checks or the hard ones only."""
    end = "ELSE 'NONE' END AS error FROM predicates)"
    return f"""t AS (SELECT *, {trim('src')} AS s, {trim('dst')} AS d FROM {source}),
predicates AS (SELECT conv_id, turn, variant, src, dst, s, d, regexp_matches(s, '^[\\s\\p{{Z}}、-〿！-／：-？［-｀｛-･!-/:-@\\[-`{{-~]*$') AS only_punctuation, len(regexp_extract_all(d, '\\\\?"\\\\?:\\\\?"')) AS json_parts,
  (NOT {repeated('s', 1, 3, 16)} AND {repeated('d', 1, 3, 16)}) OR (NOT {repeated('s', 4, 10, 4)} AND {repeated('d', 4, 10, 4)}) AS degraded, {jaccard('s', 'd')} AS jaccard, contains(s, d) OR contains(d, s) AS contained,
  length(d)::DOUBLE / nullif(length(s), 0) AS ratio, list_distinct(regexp_extract_all({half('s')}, '[0-9]+')) AS s_numbers, list_distinct(regexp_extract_all({half('d')}, '[0-9]+')) AS d_numbers, regexp_matches({half('s')}, '第[0-9]+[話话章節节回]') AS chapter FROM t),
checked AS (SELECT *, CASE WHEN d = '' THEN 'FAIL_PARSE' WHEN only_punctuation THEN 'NONE' WHEN json_parts >= 3 THEN 'JSON_STRUCTURE_ERROR' WHEN degraded THEN 'DEGRADATION' """ + (
        f"""WHEN s = d AND length(s) >= 3 AND regexp_matches(s, '[{CJK}]') THEN 'HIGH_SIMILARITY' WHEN length(s) >= 10 AND length(d) >= 5 AND (ratio < 0.3 OR ratio > 3.0) THEN 'LENGTH_MISMATCH'
  WHEN len(s_numbers) BETWEEN 1 AND 3 AND len(list_intersect(s_numbers, d_numbers)) = 0 AND chapter THEN 'LENGTH_MISMATCH' WHEN contained OR jaccard > 0.8 THEN 'HIGH_SIMILARITY' {end}"""
        if soft
        else end
    )


CHECKED = f"{PAIRS}, {checks('pairs')}"


def repaired(source: str) -> str:
    """A chain of subqueries over ``source`` (with src, dst), each one mark or quote; its last column is dst."""
    count = lambda c, x: f"(length({c}) - length(replace({c}, {q(x)}, '')))"
    for mark, others in PUNCTUATION:
        n, own, other = count("src", mark), count("dst", mark), " + ".join(count("dst", o) for o in others)
        source = f"(SELECT * REPLACE (CASE WHEN {n} > 0 AND {n} > {own} AND {n} = {own} + {other} THEN translate(dst, {q(others)}, {q(mark * len(others))}) ELSE dst END AS dst) FROM {source})"
    opening, closing = (", ".join(q(x) for x in chars) for chars in (ANY_OPENING, ANY_CLOSING))
    for a, b in QUOTES:
        source = f"(SELECT * REPLACE (CASE WHEN starts_with(src, {q(a)}) AND left(dst, 1) IN ({opening}) THEN {q(a)} || substr(dst, 2) ELSE dst END AS dst) FROM {source})"
        source = f"(SELECT * REPLACE (CASE WHEN ends_with(src, {q(b)}) AND right(dst, 1) IN ({closing}) THEN left(dst, length(dst) - 1) || {q(b)} ELSE dst END AS dst) FROM {source})"
    return source


def strip_suffixes(source: str, column: str, suffixes: list[str], rounds: int = 6) -> str:
    """A chain of subqueries, each taking the first listed suffix that fits."""
    fits = " ".join(f"WHEN ends_with({column}, {q(x)}) AND length({column}) > {len(x)} THEN left({column}, length({column}) - {len(x)})" for x in suffixes)
    for _ in range(rounds):
        source = f"(SELECT * REPLACE (CASE {fits} ELSE {column} END AS {column}) FROM {source})"
    return source


def weights(t: str, cues: dict[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({t}, {q(k)}) THEN {w} ELSE 0 END" for k, w in cues.items()) + ")"


#: Names of the test: capitalised words with affixes by the parity of line and length; entries of a glossary from them.
ENTRIES_FROM = """words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS w FROM documents),
names AS (SELECT CASE length(w) % 6 WHEN 0 THEN left(w, 5) || 'さん' WHEN 1 THEN 'お' || left(w, 4) || '姉さん' WHEN 2 THEN left(w, 5) || '君' WHEN 3 THEN left(w, 5) || '先輩ちゃん' WHEN 4 THEN '先生' ELSE left(w, 5) END AS src,
  CASE length(w) % 5 WHEN 0 THEN upper(left(w, 5)) || '君' WHEN 1 THEN upper(left(w, 5)) WHEN 2 THEN upper(left(w, 5)) || '老师君' WHEN 3 THEN 'ア ' || left(w, 2) ELSE '' END AS dst,
  CASE length(w) % 4 WHEN 0 THEN '男性' WHEN 1 THEN '' WHEN 2 THEN left(w, 5) || ',女性' ELSE left(w, 3) END AS info FROM words),
entries AS (SELECT src, dst, info FROM names)"""

_keyed = strip_suffixes("(SELECT *, CASE WHEN starts_with(src, 'お') AND length(src) > 2 THEN substr(src, 2) WHEN starts_with(src, 'ご') AND length(src) > 2 THEN substr(src, 2) ELSE src END AS key, dst AS base FROM entries)", "key", N.SUFFIXES)
_keyed = strip_suffixes(_keyed, "base", N.DST_SUFFIXES)
KEYED = f"{ENTRIES_FROM}, keyed AS (SELECT * FROM {_keyed})"
TITLES = ", ".join(map(q, N.TITLES))
#: The same entries with their document and place.
PLACED = ENTRIES_FROM.replace("words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS w FROM documents)", "word_lists AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{4,}') AS a FROM documents), words AS (SELECT doc_id, unnest(range(0, len(a))) AS p, unnest(a) AS w FROM word_lists)").replace("names AS (SELECT CASE", "names AS (SELECT doc_id, p, CASE").replace("entries AS (SELECT src", "entries AS (SELECT doc_id, p, src")
PLACED_KEYED = f"{PLACED}, keyed AS (SELECT * FROM {_keyed})"

PEOPLE = r"""split AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
scanned AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM split),
found AS (SELECT doc_id, line_no, unnest(list_filter(regexp_split_to_array(line, '[^A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{4,}$'))) AS text FROM scanned),
people AS (SELECT doc_id, line_no, text, CAST(0.8 + 0.02 * least(length(text), 9) AS FLOAT) AS score FROM found)"""

_far = lambda f: "[" + ", ".join(f"coalesce({f}({trim('line')}, {k}) OVER o, '')" for k in (range(5, 0, -1) if f == "lag" else range(1, 6))) + "]"
_full = lambda x: f"list_filter({x}, lambda z: {trim('z')} <> '')"
#: A word of a test as a name with a suffix by its length.
SUFFIXED = "left(word, 5) || CASE length(word) % 4 WHEN 0 THEN '君' WHEN 1 THEN '姉さん' ELSE '' END"


def mentions(name: str) -> str:
    """Subqueries to ``said``: the stand-in's persons in readable lines, under a name made of ``word``, with the text around each."""
    return f"""{SCANNED}, frames AS (SELECT doc_id, line_no, line, {_far('lag')} AS above, {_far('lead')} AS follow, {trim("replace(line, '　', '')")} AS z FROM scanned WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
      read AS (SELECT * FROM frames WHERE NOT (length(z) < 2 OR regexp_matches(z, '^[{L.FILLER}]+$'))),
      found AS (SELECT *, unnest(list_filter(regexp_split_to_array(line, '[^A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{4,}}$'))) AS word FROM read),
      said AS (SELECT doc_id, line_no, {name} AS name, array_to_string(list_concat({_full('above')}[-2:], [{trim('line')}], {_full('follow')}[:2]), chr(10)) AS t FROM found WHERE CAST(0.8 + 0.02 * least(length(word), 9) AS FLOAT) >= CAST(0.9 AS FLOAT))"""


_alias = strip_suffixes(f"(SELECT *, {trim("replace(name, '　', '')")} AS raw, CASE WHEN starts_with(raw, 'お') AND length(raw) > 2 THEN substr(raw, 2) WHEN starts_with(raw, 'ご') AND length(raw) > 2 THEN substr(raw, 2) ELSE raw END AS core FROM per)", "core", N.SUFFIXES)
#: Subqueries from ``said`` to ``clustered``.
CLUSTERED = f"""per AS (SELECT doc_id, name, count(*) AS count, CAST(sum({weights('t', N.MALE_CUES)}) AS BIGINT) AS male, CAST(sum({weights('t', N.FEMALE_CUES)}) AS BIGINT) AS female,
        CAST(max({weights('t', N.MENTION_CUES)} + CASE WHEN regexp_matches(t, '[「『]') THEN 4 ELSE 0 END + CASE WHEN contains(t, 'こと') THEN 2 ELSE 0 END + floor((1000 - least(line_no, 1000)) / 100)) AS BIGINT) AS best FROM said GROUP BY ALL),
      a AS (SELECT *, CASE WHEN {trim('core')} = '' THEN {trim('name')} ELSE {trim('core')} END AS key, CASE WHEN regexp_matches(raw, '(?:君|くん|クン)$') THEN 4 ELSE 0 END + CASE WHEN contains(raw, '兄') THEN 2 ELSE 0 END AS hm, CASE WHEN contains(raw, '姉') THEN 4 ELSE 0 END AS hf,
        CASE WHEN male + hm >= 6 AND male + hm >= female + hf + 3 THEN '{N.MALE}' WHEN female + hf >= 6 AND female + hf >= male + hm + 3 THEN '{N.FEMALE}' END AS side FROM {_alias}),
      w AS (SELECT *, coalesce(sum(CASE WHEN side = '{N.MALE}' THEN count END) OVER k, 0) AS wm, coalesce(sum(CASE WHEN side = '{N.FEMALE}' THEN count END) OVER k, 0) AS wf FROM a WINDOW k AS (PARTITION BY doc_id, key)),
      p AS (SELECT *, CASE WHEN wm > 0 AND wf > 0 AND coalesce(side, CASE WHEN wm >= wf THEN '{N.MALE}' ELSE '{N.FEMALE}' END) <> CASE WHEN wm >= wf THEN '{N.MALE}' ELSE '{N.FEMALE}' END THEN 1 ELSE 0 END AS part_no, (hm >= 4 AND hf = 0) OR (hf >= 4 AND hm = 0) AS hinted FROM w),
      r AS (SELECT *, CASE WHEN hinted THEN greatest(hm, hf) * 100 + best + least(count, 999) ELSE least(count, 999) * 5 + (hm + hf) * 4 + best + least(greatest(male, female), 50) END AS rank_score FROM p),
      clustered AS (SELECT *, CAST(part_no AS INTEGER) AS part, first_value(name) OVER (PARTITION BY doc_id, key, part_no ORDER BY hinted DESC, rank_score DESC, count DESC, name) AS "primary", row_number() OVER (PARTITION BY doc_id, key, part_no ORDER BY count DESC, name) AS alias_rank FROM r)"""
