"""Text predicates and transforms as native column expressions.

Character classes, word lists and limits that decide results are given under
"Fixed values"; everything else is composed from built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes (inside brackets of a Java pattern).
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}"
HALF_KATAKANA = r"\x{FF66}-\x{FF9D}"
KANA = HIRAGANA + KATAKANA
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"
CJK_PUNCTUATION = r"\x{3001}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF1F}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"
LATIN_PUNCTUATION = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
TRADITIONAL = "為國學體發會對這說嗎麼後於與過還點當場歲裡與總劃顏髮聲覺親願"
# Kana that may stay where they name a shape.
SHAPE_RUNS = ("への", "く", "へ", "し", "つ", "の", "ノ", "ハ", "コ", "ロ", "ニ")
SHAPE_MARKERS = "字形型状口角弯折线"
OPENING, CLOSING = "“\"「『《(（", "”\"」』》)）"
# Small kana that may not stand alone, punctuation and the forms that models write for it, quote pairs.
SMALL_KANA = "ッっぁぃぅぇぉゃゅょゎ"
PUNCTUATION = (("「", "“‘"), ("」", "”’"), ("『", "“‘"), ("』", "”’"), ("（", "("), ("）", ")"), ("【", "["), ("】", "]"), ("？", "?"), ("！", "!"), ("：", ":"), ("　", " "))
QUOTES = (("「", "」"), ("『", "』"), ("“", "”"), ("‘", "’"))
ANY_OPENING, ANY_CLOSING = "\"'「『“‘", "\"'」』”’"
FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９", "0123456789"


def unicode_trim(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def leading_space(c: Column) -> Column:
    return F.regexp_extract(c, r"(?U)^\s*", 0)


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def has_hiragana(c: Column) -> Column:
    return c.rlike(f"[{HIRAGANA}]")


def has_katakana(c: Column) -> Column:
    return c.rlike(f"[{KATAKANA}]")


def contains_kana(c: Column) -> Column:
    """Kana of any width; the middle dot and the long-vowel mark count."""
    return c.rlike(f"[{KANA}{HALF_KATAKANA}]")


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def has_hangul(c: Column) -> Column:
    return c.rlike(f"[{HANGUL}]")


def has_traditional(c: Column) -> Column:
    return c.rlike(f"[{TRADITIONAL}]")


def only_punctuation(c: Column) -> Column:
    """True for the empty text too; digits, U+2026 and U+2014 are not punctuation here."""
    return c.rlike(rf"(?U)^[\s{CJK_PUNCTUATION}{LATIN_PUNCTUATION}]*$")


def kana_residue(c: Column) -> Column:
    """Kana that neither stand before a shape marker nor in quotes as one of the shape runs."""
    runs = "|".join(SHAPE_RUNS)
    alone = rf"(?<![{KANA}])(?:{runs})(?=[{SHAPE_MARKERS}])|(?<=[{OPENING}])(?:{runs})(?=[{CLOSING}])"
    return F.regexp_replace(c, alone, "").rlike(f"[{KANA}]")


def repeats(c: Column, least: int, most: int, times: int) -> Column:
    """A part of least to most characters that stands times in a row, with at least one character after it."""
    return c.rlike(rf"(?s)(.{{{least},{most}}})\1{{{times - 1}}}.")


def degraded(src: Column, dst: Column) -> Column:
    return (~repeats(src, 1, 3, 16) & repeats(dst, 1, 3, 16)) | (~repeats(src, 4, 10, 4) & repeats(dst, 4, 10, 4))


def json_fragments(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r'\\?"\\?:\\?"'))


def half_digits(c: Column) -> Column:
    return F.translate(c, FULL_DIGITS, HALF_DIGITS)


def numbers(c: Column) -> Column:
    """The distinct runs of digits, full-width ones as half-width."""
    return F.array_distinct(F.regexp_extract_all(half_digits(c), F.lit(r"(?U)\d+"), F.lit(0)))


def has_chapter_number(c: Column) -> Column:
    return half_digits(c).rlike(r"(?U)第\d+[话話章節节回]")


def characters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters; 0 where both are empty."""
    x, y = characters(a), characters(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def similar(a: Column, b: Column, threshold: float = 0.8) -> Column:
    return F.contains(a, b) | F.contains(b, a) | (char_jaccard(a, b) > threshold)


def without_isolated_kana(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<![{KANA}])[{SMALL_KANA}](?![{KANA}])", "")


def _count(c: Column, part: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, part, F.lit("")))


def restore_punctuation(src: Column, dst: Column) -> Column:
    """Marks of src come back where dst has just as many of their other forms as it lacks, one mark after another."""
    marks = F.array(*(F.struct(F.lit(mark).alias("mark"), F.lit(others).alias("others"), F.lit(mark * len(others)).alias("new")) for mark, others in PUNCTUATION))

    def step(out: Column, m: Column) -> Column:
        n, own = _count(src, m["mark"]), _count(out, m["mark"])
        other = F.length(out) - F.length(F.call_function("translate", out, m["others"], F.lit("")))
        return F.when((n > 0) & (n > own) & (n == own + other), F.call_function("translate", out, m["others"], m["new"])).otherwise(out)

    return F.aggregate(marks, dst, step)


def restore_quotes(src: Column, dst: Column) -> Column:
    """The first and last quote of dst take the form of src's, pair by pair."""

    def opened(out: Column, q: Column) -> Column:
        return F.when(F.startswith(src, q["a"]) & F.left(out, F.lit(1)).isin(*ANY_OPENING), F.concat(q["a"], F.substring(out, 2, 1 << 30))).otherwise(out)

    def closed(out: Column, q: Column) -> Column:
        return F.when(F.endswith(src, q["b"]) & F.right(out, F.lit(1)).isin(*ANY_CLOSING), F.concat(F.left(out, F.length(out) - 1), q["b"])).otherwise(out)

    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(side).alias("side")) for a, b in QUOTES for side in (0, 1)))
    return F.aggregate(steps, dst, lambda out, q: F.when(q["side"] == 0, opened(out, q)).otherwise(closed(out, q)))


def repaired(src: Column, dst: Column, source_lang: str) -> Column:
    """Isolated kana, then punctuation, then quotes; an empty text stays."""
    out = without_isolated_kana(dst) if source_lang.lower() == "ja" else dst
    out = restore_quotes(src, restore_punctuation(src, out))
    return F.when(dst == "", dst).otherwise(out)


def json_escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escaped(c: Column, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if attribute else [])
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a start tag, in either kind of quotes; null if absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    a, b = F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)
    return F.when(tag.rlike(pattern), F.when(a != "", a).otherwise(b))


def without_attribute(tag: Column, name: str) -> Column:
    return F.regexp_replace(tag, rf"""(?is)\s+{name}\s*=\s*(?:"[^"]*"|'[^']*')""", "")


def with_attribute(tag: Column, name: str, value: str) -> Column:
    return F.regexp_replace(tag, r"\s*(/?)>$", f' {name}="{value}"$1>')


def resolved_path(base: Column, href: Column) -> Column:
    """href under the folder base, without its fragment and with ``.`` and ``..`` resolved."""
    whole = F.concat_ws("/", F.when(base != "", base), F.regexp_replace(href, "#.*$", ""))
    parts = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda out, p: F.when((p == "") | (p == "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.array_join(parts, "/")


def html5_fixed(c: Column) -> Column:
    """XHTML for an HTML5 reader: void elements lose their slash, other self-closed elements get an end tag."""
    void = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
    c = F.regexp_replace(c, rf"(?i)<({void})\b([^<>]*?)\s*/>", "<$1$2>")
    return F.regexp_replace(c, r"<([A-Za-z][A-Za-z0-9:-]*)\b([^<>]*?)\s*/>", "<$1$2></$1>")


def horizontal_css(c: Column) -> Column:
    """Vertical writing modes become horizontal."""
    return F.regexp_replace(c, r"(?i)((?:-webkit-|-epub-)?writing-mode\s*:\s*)(?:vertical-rl|vertical-lr|tb-rl)", "$1horizontal-tb")


def left_to_right(opf: Column) -> Column:
    """The spine's reading direction as left to right, rewritten or inserted."""
    has = opf.rlike(r"""(?is)<spine\b[^>]*page-progression-direction""")
    rewritten = F.regexp_replace(opf, r"""(?is)(<spine\b[^>]*page-progression-direction\s*=\s*)(?:"[^"]*"|'[^']*')""", '$1"ltr"')
    return F.when(has, rewritten).otherwise(F.regexp_replace(opf, r"(?i)<spine\b", '<spine page-progression-direction="ltr"'))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[/\\:*?"<>|]', "_")


def chat_endpoint(c: Column) -> Column:
    """A model service's address down to its chat completions."""
    base = F.regexp_replace(unicode_trim(c), "/+$", "")
    return F.when(base.rlike("(?i)/chat/completions$"), base).when(base.rlike(r"(?i)/v[0-9]+$"), F.concat(base, F.lit("/chat/completions"))).when(base == "", base).otherwise(F.concat(base, F.lit("/v1/chat/completions")))


def name_endpoint(c: Column) -> Column:
    """The same for the service that names are asked of: an empty address is its local one."""
    return F.when(unicode_trim(c) == "", F.lit("http://localhost:8080/v1/chat/completions")).otherwise(chat_endpoint(c))


def is_family_model(c: Column, marker: str) -> Column:
    """Whether a model's name holds the marker of a family, in either case; a generic model is one that does not."""
    return F.contains(F.lower(c), F.lit(marker.lower()))


def is_css_length(c: Column) -> Column:
    return unicode_trim(c).rlike(r"(?i)^(?:0|[0-9]+(?:\.[0-9]+)?(?:px|em|rem|%|pt|ex|ch|vh|vw))$")


def redacted(c: Column, secrets: Sequence[str]) -> Column:
    for s in secrets:
        if s:
            c = F.replace(c, F.lit(s), F.lit("***"))
    return c


def compact(c: Column, most: int) -> Column:
    """White space as single spaces, cut with an ellipsis."""
    one = F.regexp_replace(unicode_trim(c), r"(?U)\s+", " ")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.left(one, F.lit(most)), F.lit("…")))


def hms(seconds: Column) -> Column:
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = seconds.cast("long")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))


def without_thinking(c: Column) -> Column:
    """Without leading closed thinking blocks; an unclosed one stays."""
    return F.regexp_replace(c, r"(?sU)^\s*(?:<think>.*?</think>\s*|<thinking>.*?</thinking>\s*)*", "")


def token_budget(src_chars: Column, lines: Column, context_chars: Column, glossary_chars: Column) -> Column:
    """Upper limit of a response's tokens, in whole numbers."""
    need = 2 * src_chars + 48 * lines + 512 + F.least(F.floor(context_chars / 4), F.lit(1500)) + F.least(F.floor(glossary_chars / 8), F.lit(1000))
    return F.least(F.greatest(need, F.lit(1024)), F.lit(12000)).cast("long")


def lenient_json(c: Column) -> Column:
    """The JSON object in a model's answer as text: the answer itself, else a fenced block, else from the first brace to the last; null if none parses."""
    plain = unicode_trim(without_thinking(c))
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    good = lambda x: F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(good(plain), good(fenced), good(braces))
