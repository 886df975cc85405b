"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

High-recall generators, several for each kind, propose spans that may overlap each other and the
base ones: written-out and spaced e-mail addresses, phone numbers in groups, in one run or broken by marks, cards of 13 to 15
digits or with odd separators, IPv6 addresses in full and compressed, IPv4 addresses with brackets.  Each candidate gets features of its format and
context; boosted trees give it a probability, and a threshold for each generator, calibrated for precision on
held-out examples, decides.  Of overlapping accepted spans the likeliest stays, from left to right; base spans always stay.

The trees are fitted on labelled examples that this module writes itself (positives and look-alikes, a
fixed number from a fixed seed); scoring is native: patterns, features and trees
are SQL expressions, and no Python runs on the executors.

A pattern is read once a text: its matches are marked by a control character and the
text is split there, which gives the matches, what stands around them, and their
places in code points.  Places are summed by blocks of matches, so a text with very many of them takes time in proportion.

Defined results: null and empty texts have no spans; U+0001 in a text counts as another character;
repeated rows get the same answer, whatever their doc_id; other columns are ignored; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Guards that exclude no match keep long runs of letters or digits linear;
# a card's pattern takes whole runs of at least 16 digits, which is all that its length check lets through.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Generators: kind, pattern, what a text must hold for it to be tried.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?i:at) ?[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({] ?(?i:dot) ?[\])}]|\.) ?[A-Za-z0-9-]{2,24}+){1,4}+", r"[\[({] ?(?i:at) ?[\])}]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ (?i:at) [A-Za-z0-9-]{1,63}+(?: (?i:dot) [A-Za-z0-9-]{2,24}+){1,4}+", r"(?i) at [A-Za-z0-9-]+ dot "),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: @ ?|@ )[A-Za-z0-9-]{1,63}+(?: ?\. ?[A-Za-z0-9-]{2,24}+){1,4}+", r" @|@ "),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?(?![0-9A-Za-z:])", r"::"),
    ("ip", r"(?<![0-9.\])])[0-9]{1,3}+(?: ?(?:[\[(](?:\.|(?i:dot))[\])]|(?i: dot )) ?[0-9]{1,3}+){3}+(?![0-9])", r"(?i)[0-9] ?(?:[\[( ]dot|[\[(]\.)"),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![0-9])(?![ -][0-9])", r"[0-9](?:[ -]?[0-9]){12}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_ -]{1,3}+[0-9]{4}){3}(?![0-9])(?![./_ -][0-9])", r"[0-9]{4}[./_ -]{1,3}[0-9]{4}"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,5}+(?![0-9A-Za-z])", r"[0-9]\)?[ .-][0-9]"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{1,4}+\)?(?:[ .-]\(?[0-9]{2,4}+\)?){2,5}+(?![0-9A-Za-z])", r"[0-9]\)?[ .-]\(?[0-9]"),
    ("phone", r"(?<![0-9A-Za-z+._-])[0-9]{10,11}+(?![0-9A-Za-z_.-])", r"[0-9]{10}"),
    ("phone", r"\+[0-9]{1,3}+[^0-9A-Za-z\n]{1,6}[0-9]{2,4}+[^0-9A-Za-z\n]{1,6}[0-9]{3,4}+(?:[^0-9A-Za-z\n]{1,6}[0-9]{2,4}+){0,2}(?![0-9A-Za-z])", r"\+[0-9]{1,3}[^0-9A-Za-z]"),
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IS_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# Words that announce personal data.
CUES = r"(?i)\b(?:tel|phone|mobile|cell|call|fax|whatsapp|card|visa|amex|mastercard|credit|mail|e-mail|email|contact|ip|address|host|reach)\b[^A-Za-z]*$"
FEATURES = ("form", "length", "digits", "groups", "luhn", "cue", "touches_before", "touches_after", "brackets", "distinct", "largest", "marks")

_MARK = "\x01"
_SPAN = "array<struct<kind:int,start:int,end:int,m:string,before:string,after:string>>"
#: Matches whose places are summed one by one.
_BLOCK = 128


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a value under a name, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spans_of(text: str, pattern: str, kind: int) -> str:
    """SQL: the matches of a pattern in the column ``text``, in order."""
    # Pieces alternate between gaps and matches: match j of a block is its piece 2 j.
    pieces = f"split(regexp_replace(translate({text}, '\\u0001', '\\u0002'), {_literal(pattern)}, '\\u0001$0\\u0001'), '\\u0001', -1)"
    total = lambda x: f"aggregate({x}, 0, (a, q) -> a + length(q))"
    blocks = f"sequence(0, cast((size(ps) div 2 - 1) div {_BLOCK} as int))"
    sizes = f"transform({blocks}, b -> {total(f'slice(ps, b * {2 * _BLOCK} + 1, {2 * _BLOCK})')})"
    start = f"base + {total('slice(own, 1, 2 * j - 1)')}"
    one = _let("at", start, f"named_struct('kind', {kind}, 'start', at, 'end', at + length(element_at(own, 2 * j)), 'm', element_at(own, 2 * j), 'before', right(element_at(own, 2 * j - 1), 32), 'after', left(element_at(own, 2 * j + 1), 8))")
    block = _let("base", "aggregate(slice(sizes, 1, b), 0, (a, n) -> a + n)", _let("own", f"slice(ps, b * {2 * _BLOCK} + 1, {2 * _BLOCK} + 1)", f"transform(sequence(1, cast(size(own) div 2 as int)), j -> {one})"))
    found = _let("sizes", sizes, f"flatten(transform({blocks}, b -> {block}))")
    return _let("ps", pieces, f"case when size(ps) > 1 then {found} else cast(array() as {_SPAN}) end")


def _guarded(text: str, pattern: str, kind: int, condition: str | None) -> str:
    found = spans_of(text, pattern, kind)
    return f"case when {condition} then {found} else cast(array() as {_SPAN}) end" if condition else found


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    d = f"cast(substr({digits}, length({digits}) + 1 - i, 1) as int)"
    return f"(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + case when i % 2 = 1 then {d} when {d} > 4 then 2 * {d} - 9 else 2 * {d} end) % 10 = 0)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


_BASE_TEST = {
    "email": "true",
    "ip": f"s.m rlike {_literal(IS_IP)}",
    "card": f"length({_digits('s.m')}) between 16 and 19 and {_luhn(_digits('s.m'))}",
    "phone": f"length({_digits('s.m')}) between 8 and 15",
}


def base_spans(text: str = "text") -> str:
    """SQL: the base spans by kind, then start."""
    parts = []
    for k, kind in enumerate(KINDS):
        need = NEEDS[kind]
        condition = f"instr({text}, '{need}') > 0" if need else f"{text} rlike '[0-9](?:[ -]?[0-9]){{15}}'"
        parts.append(f"filter({_guarded(text, BASE[kind], k, condition)}, s -> {_BASE_TEST[kind]})")
    return f"concat({', '.join(parts)})"


def candidate_spans(text: str = "text") -> str:
    """SQL: what the generators propose; the field kind is the generator's number."""
    parts = [_guarded(text, pattern, k, f"{text} rlike {_literal(need)}") for k, (_, pattern, need) in enumerate(GENERATORS)]
    return f"concat({', '.join(parts)})"


def features_sql(s: str) -> dict[str, str]:
    d = _digits(f"{s}.m")
    return {
        "form": f"{s}.kind", "length": f"length({s}.m)", "digits": f"length({d})", "groups": f"size(split({s}.m, '[^0-9A-Za-z]+', -1))",
        "luhn": f"case when length({d}) > 1 and {_luhn(d)} then 1 else 0 end", "cue": f"case when {s}.before rlike {_literal(CUES)} then 1 else 0 end",
        "touches_before": f"case when {s}.before rlike '[0-9A-Za-z_/=.-]$' then 1 else 0 end", "touches_after": f"case when {s}.after rlike '^[0-9A-Za-z_/=-]' then 1 else 0 end",
        "brackets": f"case when {s}.m rlike '[()]' then 1 else 0 end", "distinct": f"size(array_distinct(split({d}, '')))",
        "largest": f"coalesce(array_max(transform(regexp_extract_all({s}.m, '[0-9]{{1,3}}', 0), x -> cast(x as int))), -1)", "marks": f"length(regexp_replace({s}.m, '[0-9A-Za-z ().-]', ''))",
    }


def features_of(form: int, m: str, before: str, after: str) -> list[float]:
    """The features in Python, for the examples; a test holds them against the SQL ones."""
    d = re.sub("[^0-9]", "", m)
    total = 0
    for i, c in enumerate(reversed(d), 1):
        x = int(c)
        total += x if i % 2 else (2 * x - 9 if x > 4 else 2 * x)
    return [
        form, len(m), len(d), len(re.split("[^0-9A-Za-z]+", m)), int(len(d) > 1 and total % 10 == 0), int(bool(re.search(CUES, before[-32:]))),
        int(bool(re.search("[0-9A-Za-z_/=.-]$", before))), int(bool(re.match("[0-9A-Za-z_/=-]", after))), int(bool(re.search("[()]", m))), len(set(d)) if d else 1,
        max(map(int, re.findall("[0-9]{1,3}", m)), default=-1), len(re.sub("[0-9A-Za-z ().-]", "", m)),
    ]


def examples(n: int = 9000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates: n draws of personal data and of look-alikes, as many of each generator."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda least=2: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(least, 9)))
    hexes = lambda: "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, rng.integers(1, 5)))
    octet = lambda top=256: str(rng.integers(0, top))
    top = lambda: pick("com", "org", "net", "de", "io")

    def luhn(k: int, good: bool) -> str:
        d = digits(k - 1)
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)), 1))
        return d + str((-total + (0 if good else rng.integers(1, 10))) % 10)

    def cut(d: str, *sizes: int, by: str = " ") -> str:
        at = np.cumsum([0, *sizes])
        return by.join(d[a:b] for a, b in zip(at, at[1:]))

    real_forms = (
        lambda: f"{word()}.{word()} [at] {word()} [dot] {top()}",
        lambda: f"{pick(word(), f'{word()}.{word()}')} at {word()} dot {top()}",
        lambda: f"{pick(word(), f'{word()}.{word()}')}{pick(' @ ', ' @', '@ ')}{word()}{pick('.', ' . ')}{top()}",
        lambda: ":".join(hexes() for _ in range(8)),
        lambda: f"{pick('2001', 'fe80', 'fd00', '2a02')}{pick('', ':' + hexes())}::{':'.join(hexes() for _ in range(rng.integers(1, 5)))}",
        lambda: pick("[.]", "(.)", "[dot]", " dot ").join(octet() for _ in range(4)),
        lambda: cut(luhn(15, True), 4, 6, 5) if rng.random() < 0.5 else luhn(int(rng.integers(13, 16)), True),
        lambda: cut(luhn(16, True), 4, 4, 4, 4, by=pick(".", "/", "_", "  ")),
        lambda: pick(f"({digits(3)}) {digits(3)}-{digits(4)}", cut(digits(10), 3, 3, 4, by=pick("-", ".", " "))),
        lambda: pick(f"1-{cut(digits(10), 3, 3, 4, by='-')}", cut("0" + digits(9), 2, 2, 2, 2, 2), cut("0" + digits(10), 3, 4, 4), f"0{digits(2)} {digits(3)} {digits(2)} {digits(2)}", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: pick("", "0", "1") + pick("2", "5", "7") + digits(9),
        lambda: f"+{pick('1', '44', '49', '33')}{pick('%%% ', '!! ', '### ', '*** ', ' / ')}({digits(3)}){pick(' ', '%%% ', '!! ')}{digits(3)}{pick('-', '!! ')}{digits(4)}",
    )
    false_forms = (
        lambda: pick(f"{word()} (at) {digits(2)}.{digits(2)}", f"{word()}{{at}}{digits(3)}.{digits(2)}", f"{digits(2)} (at) {word()}.{digits(2)}"),
        lambda: pick(f"{word()} at {word()} dot {word(5)}", f"{word()} at {digits(2)} dot {digits(2)}"),
        lambda: pick(f"{digits(2)} @ {digits(2)}.{digits(2)}", f"{word()} @ {digits(1)}.{digits(2)}", f"{digits(3)} @{word()}.{word(5)}"),
        lambda: ":".join(digits(2) for _ in range(8)),
        lambda: pick("::", f"::{hexes()}", f"{hexes()}::", f"{pick('a', 'c', 'be', 'add')}::{pick('b', 'fade', 'dead')}"),
        lambda: pick("[.]", "(.)", " dot ").join(str(rng.integers(256, 1000)) if rng.random() < 0.6 else octet() for _ in range(4)),
        lambda: luhn(int(rng.integers(13, 16)), False),
        lambda: cut(luhn(16, False), 4, 4, 4, 4, by=pick(".", "/", "_", "  ", " - ")),
        lambda: pick(cut(digits(12), 4, 4, 4, by="-"), cut(digits(8), 2, 3, 3, by=pick(" ", ".")), cut(digits(13), 4, 4, 5), cut(digits(9), 3, 3, 3)),
        lambda: pick(f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 32)}", f"{rng.integers(1, 32)}.{rng.integers(10, 13)}.{rng.integers(1900, 2100)}", cut(digits(9), 3, 3, 3, by=pick(".", " ")), f"{digits(1)}.{digits(2)}.{digits(2)}", cut(digits(16), 4, 4, 4, 4), f"{digits(2)} {digits(2)} {digits(2)}"),
        lambda: pick(str(rng.integers(1_400_000_000, 1_800_000_000)), "0" * int(rng.integers(4, 7)) + digits(5), digits(11), digits(10)),
        lambda: pick(f"+{digits(1)} / {digits(2)} / {digits(3)}", f"+{digits(2)}% ({digits(2)}) {digits(3)}", f"+{digits(3)}, +{digits(3)}, +{digits(3)}"),
    )
    cues = {"email": ("mail ", "contact: ", "E-mail: ", "reach "), "ip": ("host ", "ip: ", "address "), "card": ("card ", "visa no. ", "credit card: "), "phone": ("call ", "phone: ", "Tel. ", "mobile ", "fax: ")}
    rows, labels = [], []
    for k in range(n):
        form, real = k % len(GENERATORS), bool(rng.integers(2))
        m = (real_forms if real else false_forms)[form]()
        before = pick(*cues[GENERATORS[form][0]]) if rng.random() < (0.7 if real else 0.02) else f"{word()} "
        if not real and rng.random() < 0.3:
            before = pick("$", "no ", "=", "/", "#", "id ")
        after = pick(" ", ".", ", ", "\n") + word() if real or rng.random() < 0.8 else pick("/", "=", "-", "_", "%") + word()
        rows.append(features_of(form, m, before, after))
        labels.append(real)
    return np.array(rows, dtype=float), np.array(labels, dtype=float)


Tree = tuple  # (feature, threshold, left, right) or a float; left holds what is at most the threshold


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float) -> Tree | float:
    leaf = float(-grad.sum() / (hess.sum() + 1.0)) * rate
    if depth == 0 or len(x) < 20:
        return leaf
    best, whole = None, grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = g[at] ** 2 / (h[at] + 1) + (g[-1] - g[at]) ** 2 / (h[-1] - h[at] + 1) - whole
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0] + 1e-9:
                best = gain[k], f, (v[at[k]] + v[at[k] + 1]) / 2
    if best is None or best[0] < 1e-6:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], round(float(best[2]), 3), _grow(x[left], grad[left], hess[left], depth - 1, rate), _grow(x[~left], grad[~left], hess[~left], depth - 1, rate)


def _predict(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _predict(tree[2], x), _predict(tree[3], x))


@functools.cache
def model(trees: int = 32, depth: int = 4, rate: float = 0.3, precision: float = 0.97) -> tuple[tuple, tuple[float, ...]]:
    """(trees, threshold of the summed scores for each generator): a third of the examples calibrates."""
    x, y = examples()
    fit = np.arange(len(y)) // len(GENERATORS) % 3 != 0
    score, grown = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x[fit], (p - y)[fit], (p * (1 - p))[fit], depth, rate)
        grown.append(tree)
        score += _predict(tree, x)
    limits = []
    for k in range(len(GENERATORS)):
        own = ~fit & (x[:, 0] == k)
        order = np.argsort(-score[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        last = np.append(score[own][order][1:] < score[own][order][:-1], True)  # equal scores are taken or left together
        good = np.flatnonzero((right >= precision) & last)
        limits.append(float(score[own][order][good[-1]]) if len(good) else 1e9)
    return tuple(grown), tuple(round(x, 6) for x in limits)


def _tree_sql(tree: Tree | float) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    return f"case when f.{FEATURES[tree[0]]} <= {tree[1]}D then {_tree_sql(tree[2])} else {_tree_sql(tree[3])} end"


def scored_sql(candidates: str) -> str:
    """SQL: candidates above their generator's threshold, as (kind, start, end, score)."""
    trees, limits = model()
    features = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in features_sql("c").items()) + ")"
    total = " + ".join(f"({_tree_sql(t)})" for t in trees)
    withf = f"transform({candidates}, c -> named_struct('c', c, 'f', {features}))"
    kinds = f"array({', '.join(str(KINDS.index(k)) for k, _, _ in GENERATORS)})"
    scored = f"transform({withf}, x -> named_struct('kind', element_at({kinds}, x.c.kind + 1), 'start', x.c.start, 'end', x.c.end, 'score', {total.replace('f.', 'x.f.')} - element_at(array({', '.join(f'{x}D' for x in limits)}), x.c.kind + 1)))"
    return f"filter({scored}, s -> s.score >= 0)"


def _apart() -> str:
    """SQL: of ``_more`` what overlaps no base span and no likelier candidate, in one pass from left to right.

    The last candidate waits until something begins after its end; what overlaps it and is likelier takes its place.
    """
    every = "array_sort(concat(transform(_base, b -> named_struct('start', b.start, 'base', true, 'end', b.end, 'kind', b.kind, 'score', 0D)), transform(_more, m -> named_struct('start', m.start, 'base', false, 'end', m.end, 'kind', m.kind, 'score', m.score))))"
    span = "named_struct('kind', {0}.kind, 'start', {0}.start, 'end', {0}.end)"
    free, over = "not x.base and x.start >= s.reach", "s.last.end > x.start"
    spans = "array<struct<kind:int,start:int,end:int>>"
    none = "named_struct('start', 0, 'base', false, 'end', -1, 'kind', 0, 'score', 0D)"
    last = f"case when x.base and {over} then {none} when x.base then s.last when not ({free}) then s.last when {over} and s.last.score >= x.score then s.last else x end"
    done = f"s.last.end >= 0 and {free} and not ({over})"
    # The state is copied with each step: spans of a block gather by themselves, and blocks in the outer state.
    inner = f"""aggregate(own, named_struct('reach', t.reach, 'last', t.last, 'cur', cast(array() as {spans})),
      (s, x) -> named_struct('reach', case when x.base then greatest(s.reach, x.end) else s.reach end, 'last', {last}, 'cur', case when {done} then concat(s.cur, array({span.format('s.last')})) else s.cur end))"""
    step = _let("r", inner, "named_struct('reach', r.reach, 'last', r.last, 'out', concat(t.out, array(r.cur)))")
    blocks = f"transform(sequence(0, cast((size(es) - 1) div {2 * _BLOCK} as int)), b -> slice(es, b * {2 * _BLOCK} + 1, {2 * _BLOCK}))"
    swept = f"""aggregate({blocks}, named_struct('reach', 0, 'last', {none}, 'out', cast(array() as array<{spans}>)), (t, own) -> {step},
      t -> concat(flatten(t.out), case when t.last.end >= 0 then array({span.format('t.last')}) else cast(array() as {spans}) end))"""
    return _let("es", every, swept)


def _with_spans(rows: DataFrame) -> DataFrame:
    """rows with _base and _spans, from the column _text."""
    plain = "transform({}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
    none = "cast(array() as array<struct<kind:int,start:int,end:int,score:double>>)"
    more = f"case when _text rlike {_literal(any_candidate())} then {scored_sql(candidate_spans('_text'))} else {none} end"
    found = rows.withColumns({"_base": F.expr(plain.format(base_spans("_text"))), "_more": F.expr(more)})
    # Without a candidate the base spans are all; most texts have none.
    return found.withColumn("_spans", F.expr(f"case when size(_more) = 0 then array_sort(_base) else array_sort(concat(_base, {_apart()})) end")).drop("_more")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, by kind and start) of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return _with_spans(rows).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def any_candidate() -> str:
    return "|".join(f"(?:{need})" for _, _, need in GENERATORS)


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.end)), ',')")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets; overlapping spans give a mark each."""
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    marked = _with_spans(docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    by_place = "array_sort(transform(_spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    text = f"""aggregate({by_place}, named_struct('at', 0, 'out', ''),
      (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', concat(a.out, substr(_text, a.at + 1, greatest(0, s.start - a.at)), element_at({names}, s.kind + 1))),
      a -> concat(a.out, substr(_text, a.at + 1)))"""
    return marked.withColumn("text", F.expr(f"case when size(_spans) = 0 then text else {text} end")).select(*docs.columns)
