"""Secret scan: base patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax into name-literal pairs: a
name, optional closing quotes or brackets, an optional type, one of ``= ?= := : =>``, and an
expression of quoted literals and names joined by ``+``, or an unquoted literal: what
stands up to the next blank (or the next pair, or a quote that closes around the pair), unless it is a
known constant, a reference, a call or the first word of a sentence.  Literals bound to a name
are constants; a later pair that refers to the name takes its value (and the
span of its literals), and so does an earlier one if the name was not bound by then.  Each pair is scored by how sensitive its target name is
and by how random its value looks; literals above the threshold are spans
of kind ``assign`` beside the base ones.

Defined results: null and empty texts have no spans; equal added and base
spans are listed once; unquoted literals inside a base span are not listed again; constants hold within one document; repeated rows get the same answer; texts are read whole, in
time and memory in proportion to their length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN = 8

# Parts of names and how sensitive they make a target.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8,
    "private": 0.6, "auth": 0.6, "access": 0.4, "key": 0.4, "signing": 0.4, "encryption": 0.4, "client": 0.1, "session": 0.4, "bearer": 0.8, "salt": 0.5, "dsn": 0.5,
}
# Parts that say that the value is not itself a secret.
HARMLESS = {"id", "name", "path", "file", "url", "uri", "type", "count", "length", "size", "public", "hash", "example", "field", "label", "regex", "pattern", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:change_?me|example|placeholder|your[-_ ].*|x{4,}|\*{3,}|<.*>|\$\{.*\}|%\(.*|none|null|true|false|todo)$")
THRESHOLD = 1.15

_LITERAL = r'"(?:[^"\\\n]|\\[^\n])*+"|\'(?:[^\'\\\n]|\\[^\n])*+\''
_WORD = r"[A-Za-z_][A-Za-z0-9_.]*+"
# A type stands after a colon (or is a well-known word), and a quoted literal or, set off by blanks, a name after its "=".
_TYPE = rf"""(?:[ \t]*:[ \t]*[&*]?(?:'[a-z_]+[ \t]+)?(?:mut[ \t]+)?(?:{_WORD}(?:::{_WORD})*+)?(?:[\[<][^\n="']{{0,80}}[\]>])?[?!]?(?:[ \t]*\|[ \t]*{_WORD})*+|[ \t]+(?i:string|\[\]byte|n?varchar2?|n?char|text)(?:\([0-9 ]+\))?)"""
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["'\]]{{0,2}}(?:{_TYPE}(?:[ \t]*:?=[ \t]*(?=[bBrRuU]?["'])|[ \t]+:?=[ \t]+(?=[A-Za-z_]))|[ \t]*(?::=|=>|\??=(?![=~])|:(?!:))[ \t]*)""")
_VALUE = re.compile(rf"(?:[bBrRuU]?(?:{_LITERAL})|{_WORD})(?:[ \t]*\+[ \t]*(?:{_LITERAL}|{_WORD}))*+")
# An unquoted literal begins after the scheme of a header, and ends before these.
_BARE = re.compile(r"""(?:(?:[Bb]earer|[Bb]asic)[ \t]+)?(?=[^\s"'`{\[(<])""")
_BLANK = re.compile(r"\s|\Z")
_BARE_END = re.compile(r"""["'`](?=[\s,;:)\]}>]|$)|[,;&](?=["']?[A-Za-z_][A-Za-z0-9_.-]*+["']?[=:])|\s|\Z""")
_REFERENCE = re.compile(r"\$(?:\{(?P<inner>[A-Za-z_]\w*)[^}\s]*\}|(?P<plain>[A-Za-z_]\w*))")
_CODE = re.compile(r"[A-Za-z_][\w.]*(?:::\w+)*[(\[]|//|/\*|(?:[A-Za-z_]+(?:(?:\.|->|::)[A-Za-z_]+)+|undefined)\Z")
_LETTERS = re.compile(r"[^\W\d_]+\Z")
_PART = re.compile(rf"{_LITERAL}|[A-Za-z_][A-Za-z0-9_.]*+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> float:
    parts = [x.lower() for x in _NAME_PART.findall(name)]
    if "api" in parts and "key" in parts:
        parts.append("apikey")
    if parts and parts[-1] in HARMLESS:
        return 0.0
    return min(1.0, sum(SENSITIVE.get(x, 0.0) for x in set(parts)))


def value_score(value: str) -> float:
    """0 to 1: bits a character against what random letters and digits would have."""
    return _score(len(value), Counter(value), value)


def _score(n: float, counts: dict[str, float], ends: str) -> float:
    """The score of a value by its length, its characters, and its text or (of a long one) its ends."""
    if n < MIN_ASSIGN or PLACEHOLDER.match(ends) or any(map(str.isspace, counts)):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / math.log2(min(n, 64)) * (0.55 + 0.15 * classes))


_ENDS = 64
#: An unquoted literal up to this long may be a name that is bound further on.
_LONGEST_NAME = 256
_NAME = re.compile(_WORD)


class _Value:
    """A literal of the text, or several values joined.

    It holds no text but its ends; joined values share their parts, so that a
    text's values take memory in proportion to the text.
    """

    __slots__ = ("span", "parts", "n", "counts", "ends")

    def __init__(self, n: float, counts: dict[str, float], ends: str, span: tuple[int, int] | None = None, parts: tuple[_Value, ...] = ()):
        self.span, self.parts, self.n, self.counts, self.ends = span, parts, n, counts, ends

    @staticmethod
    def literal(text: str, a: int, b: int, counts: dict[str, float] | None = None) -> _Value:
        ends = text[a:b] if b - a <= 2 * _ENDS else text[a : a + _ENDS] + text[b - _ENDS : b]
        return _Value(b - a, Counter(text[a:b]) if counts is None else counts, ends, (a, b))

    @staticmethod
    def joined(parts: list[_Value]) -> _Value:
        if len(parts) == 1:
            return parts[0]
        n, ends, counts = 0.0, "", Counter()
        for x in parts:
            n, ends = n + x.n, ends + x.ends
            for c, k in x.counts.items():
                counts[c] += k
        if n > 2 * _ENDS:
            ends = ends[:_ENDS] + ends[-_ENDS:]
        if n > 1e15:  # names that double each other: shares are all that counts by then
            counts, n = {c: k / n * 1e12 for c, k in counts.items()}, 1e12
        return _Value(n, counts, ends, parts=tuple(parts))

    def score(self) -> float:
        return _score(self.n, self.counts, self.ends)


class _Bare:
    """Unquoted literals of a text, asked for by ascending places; one may hold the next, up to the same end."""

    def __init__(self, text: str):
        self.text = text
        self.run = self.cut = self.last = (0, 0)
        self.counts: Counter = Counter()

    def at(self, place: int) -> _Value | None:
        """The unquoted literal at a place, if one is there."""
        text = self.text
        m = _BARE.match(text, place)
        if not m:
            return None
        a = m.end()
        if text[a] == "#" and text[a - 1] in " \t":
            return None
        if not self.run[0] <= a < self.run[1]:
            self.run = a, _BLANK.search(text, a).start()
        if not self.cut[0] <= a <= self.cut[1]:
            self.cut = a, _BARE_END.search(text, a, self.run[1]).start()
        b = self.cut[1]
        for closing, opening in ((",;\"'`", ""), (")", "("), ("]", "["), ("}", "{"), (",;\"'`", "")):
            if b > a and text[b - 1] in closing and (not opening or text.find(opening, a, b) < 0):
                while b > a and text[b - 1] in closing:
                    b -= 1
        if b == a or _CODE.match(text, a, b):
            return None
        # A plain word before others begins a sentence.
        if _LETTERS.match(text, a, b) and text[self.run[1] : self.run[1] + 2].lstrip(" \t")[:1].isalpha():
            return None
        if self.last[1] == b and self.last[0] <= a:
            self.counts = self.counts - Counter(text[self.last[0] : a])
        else:
            self.counts = Counter(text[a:b])
        self.last = a, b
        return _Value.literal(text, a, b, self.counts)


def lexed_secrets(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans (code points) of literals whose value ends up in a sensitive name."""
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, _Value] = {}
    secret: list[_Value] = []
    waiting: dict[str, list[tuple[str, _Value | None]]] = {}  # by a name that is not bound yet: the pair's name, and the literal that the name looked like
    bare = _Bare(text)
    here = 0

    def bind(name: str, whole: _Value) -> None:
        constants[name] = whole
        own = name_score(name)
        if own + 1 >= threshold and own + (score := whole.score()) >= threshold and score > 0:
            secret.append(whole)

    while m := _PAIR.search(text, here):
        here = base = m.end()
        parts: list[_Value] = []
        if v := _VALUE.match(text, base):
            read = list(_PART.finditer(v[0]))
            quoted = any(p[0][0] in "\"'" for p in read)
            if quoted or any(p[0] in constants for p in read) and not text[v.end() : v.end() + 1].strip(" \t\r\n,;)]}#"):
                for p in read:
                    if p[0][0] in "\"'":
                        parts.append(_Value.literal(text, base + p.start() + 1, base + p.end() - 1))
                    elif p[0] in constants:
                        parts.append(constants[p[0]])
                here = v.end()
        if not parts and (r := _REFERENCE.match(text, base)) and not text[r.end() : r.end() + 1].strip(" \t\r\n,;)]}#\"'"):
            name = r["inner"] or r["plain"]
            if name in constants:
                parts = [constants[name]]
            else:
                waiting.setdefault(name, []).append((m["name"], None))
        elif not parts and (literal := bare.at(base)):
            parts = [literal]
            if literal.n <= _LONGEST_NAME and _NAME.fullmatch(text, *literal.span):
                waiting.setdefault(text[slice(*literal.span)], []).append((m["name"], literal))
        if parts:
            bind(m["name"], _Value.joined(parts))
    # Names that are bound further on.
    bound, no_literal = [x for x in waiting if x in constants], set()
    while bound:
        name = bound.pop()
        for target, literal in waiting.pop(name, ()):
            value = constants[name]
            if value is literal:
                continue
            if literal is not None:
                no_literal.add(id(literal))
            if literal is not None and constants.get(target) is not literal:
                if name_score(target) + value.score() >= threshold and value.score() > 0:
                    secret.append(value)
                continue
            bind(target, value)
            bound.append(target)
    found, seen = set(), no_literal
    while secret:
        x = secret.pop()
        if id(x) not in seen:
            seen.add(id(x))
            secret.extend(x.parts)
            if x.span:
                found.add(x.span)
    return sorted(found)


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def all_secrets(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), by start and then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_secrets(text), key=order)
    starts, reach = [a for _, a, _ in base], [0, *itertools.accumulate((b for _, _, b in base), max)]
    added = [("assign", a, b) for a, b in lexed_secrets(text) if text[a - 1] in "\"'" or reach[bisect.bisect_right(starts, a)] < b]
    return base, sorted({*base, *added}, key=order)


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        at = batch.schema.get_field_index("text")
        base, spans = [], []
        for text in batch.column(at):
            b, s = all_secrets(text.as_py() or "")
            base.append([dict(zip(("kind", "start", "end"), x)) for x in b])
            spans.append([dict(zip(("kind", "start", "end"), x)) for x in s])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for each row of docs."""
    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.releasing(_scan), f"doc_id long, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def _masker(mask: str):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            at = batch.schema.get_field_index("text")
            out = []
            for x in batch.column(at):
                text = x.as_py()
                if text:
                    parts, here = [], 0
                    for _, a, b in all_secrets(text)[1]:
                        if b > here:
                            parts += [text[here : max(a, here)], mask if a >= here else ""]
                            here = b
                    text = "".join(parts) + text[here:] if here else text
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return redact


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every found span of the text replaced; overlapping spans are one."""
    return docs.mapInArrow(K.releasing(_masker(mask)), docs.schema)


def base_digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_join(spans).encode()).hexdigest()
