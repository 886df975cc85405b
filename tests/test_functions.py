import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.functions import names as N
from linewright.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, f, *inputs):
    return [r[0] for r in values(spark, [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, " + ", ".join(f"c{k} string" for k in range(len(inputs[0]) if isinstance(inputs[0], tuple) else 1)), f)]


A = B = None


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns need a running session."""
    global A, B
    A, B = F.col("c0"), F.col("c1")


def test_trim_and_blank(spark):
    assert one(spark, T.unicode_trim(A), "　 a b\t ", "", "　") == ["a b", "", ""]
    assert one(spark, T.is_blank(A), "　\t", "", "x") == [True, True, False]
    assert one(spark, T.leading_space(A), "　 x ", "x") == ["　 ", ""]


def test_repeats(spark):
    short = lambda s: T.repeats(s, 1, 3, 16)
    assert one(spark, short(A), "a" * 16, "a" * 17, "b" + "a" * 16, "b" + "a" * 17, "abc" * 16, "abc" * 16 + "x", "") == [False, True, False, True, False, True, False]
    assert one(spark, T.repeats(A, 4, 10, 4), "abcd" * 4, "abcd" * 4 + "x", "0123456789" * 4 + "!") == [False, True, True]


def test_kana(spark):
    assert one(spark, T.kana_residue(A), "く字形", "「の」", "これは", "漢字", "へ", "コ型とア", "(への)") == [False, False, True, False, True, True, False]
    assert one(spark, T.without_isolated_kana(A), "啊ッ！", "アッ", "ッ", "っっ") == ["啊！", "アッ", "", "っっ"]
    assert one(spark, T.contains_kana(A), "ｱ", "・", "漢", "a") == [True, True, False, False]


def test_similarity(spark):
    assert one(spark, T.char_jaccard(A, B), ("abc", "cab"), ("ab", "cd"), ("", "")) == [1.0, 0.0, 0.0]
    assert one(spark, T.similar(A, B), ("abc", "xabcx"), ("abcdefghij", "bcdefghija"), ("abc", "xyz")) == [True, True, False]


def test_repair(spark):
    got = one(spark, T.repaired(A, B, "ja"), ("「はい」", "“好”"), ("（a）", "(a)"), ("「a」", ""), ("「a「b」」", "“a“b”"), ("？", "?ッ"), ("『x』", '"x"'))
    assert got == ["「好」", "（a）", "", "「a「b」", "？", "『x』"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("「」『』“”‘’\"'()（）?？aッア ", max_size=9), st.text("「」『』“”‘’\"'()（）?？aッア ", max_size=9)), min_size=1, max_size=8))
def test_repair_against_loops(spark, pairs):
    def loops(src, dst):
        if not dst:
            return dst
        kana = lambda c: "぀" <= c <= "ヿ"
        out = "".join(c for k, c in enumerate(dst) if not (c in T.SMALL_KANA and not (k and kana(dst[k - 1])) and not (k + 1 < len(dst) and kana(dst[k + 1]))))
        for mark, others in T.PUNCTUATION:
            n, own, other = src.count(mark), out.count(mark), sum(out.count(o) for o in others)
            if 0 < n and n > own and n == own + other:
                for o in others:
                    out = out.replace(o, mark)
        for a, b in T.QUOTES:
            if src.startswith(a) and out and out[0] in T.ANY_OPENING:
                out = a + out[1:]
            if src.endswith(b) and out and out[-1] in T.ANY_CLOSING:
                out = out[:-1] + b
        return out

    assert one(spark, T.repaired(A, B, "ja"), *pairs) == [loops(*p) for p in pairs]


def test_numbers_and_fragments(spark):
    assert one(spark, F.array_join(T.numbers(A), ","), "第１２話 12 3", "x") == ["12,3", ""]
    assert one(spark, T.has_chapter_number(A), "第１２話", "第話", "第3回") == [True, False, True]
    assert one(spark, T.json_fragments(A), '{"1":"a"}\\":\\"', "x") == [2, 0]


def test_markup_functions(spark):
    assert one(spark, T.html_escaped(A, True), "<a & \"b\">") == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert one(spark, T.attribute(A, "href"), "<a HREF='x y'>", '<a href="">', "<a>") == ["x y", "", None]
    assert one(spark, T.without_attribute(A, "id"), '<p id="a" class="b">') == ['<p class="b">']
    assert one(spark, T.with_attribute(A, "class", "c"), "<p>", "<br/>") == ['<p class="c">', '<br class="c"/>']
    assert one(spark, T.resolved_path(A, B), ("OEBPS", "../a/./b.html#x"), ("", "x/y"), ("a/b", "../../../c")) == ["a/b.html", "x/y", "c"]
    assert one(spark, T.html5_fixed(A), '<br/><p class="x"/><img src="a" />') == ['<br><p class="x"></p><img src="a">']
    css = one(spark, T.horizontal_css(T.horizontal_css(A)), "p{writing-mode: vertical-rl;-epub-writing-mode:tb-rl}")
    assert css == ["p{writing-mode: horizontal-tb;-epub-writing-mode:horizontal-tb}"]
    opf = one(spark, T.left_to_right(T.left_to_right(A)), '<spine toc="n">', '<spine page-progression-direction="rtl">')
    assert opf == ['<spine page-progression-direction="ltr" toc="n">', '<spine page-progression-direction="ltr">']


def test_small_texts(spark):
    assert one(spark, T.without_thinking(A), "<think>a</think> <thinking>b</thinking>c", "<think>open", " x") == ["c", "<think>open", "x"]
    assert one(spark, T.chat_endpoint(A), "http://h/v1/", "http://h", "http://h/v1/chat/completions", "") == ["http://h/v1/chat/completions"] * 3 + [""]
    assert one(spark, T.is_css_length(A), "1em", "0", "1.5rem", "1", "red") == [True, True, True, False, False]
    assert one(spark, T.safe_name(A), "a/b:c") == ["a_b_c"] and one(spark, T.compact(A, 3), " a \n b c") == ["a b…"]
    assert one(spark, T.hms(F.length(A) * 1000), "abcd") == ["01:06:40"]
    assert one(spark, T.redacted(A, ["key"]), "my key") == ["my ***"]


@pytest.mark.parametrize("chars,lines,context,glossary,want", [(0, 0, 0, 0, 1024), (1000, 10, 0, 0, 2992), (10_000, 10, 0, 0, 12000), (400, 1, 100_000, 0, 2860), (400, 1, 0, 100_000, 2360), (400, 1, 7, 15, 1362)])
def test_token_budget(spark, chars, lines, context, glossary, want):
    assert spark.range(1).select(T.token_budget(F.lit(chars), F.lit(lines), F.lit(context), F.lit(glossary))).first()[0] == want


def test_names(spark):
    assert one(spark, N.strip_affixes(A), "お兄様", "田中さん", "先輩", "田中先輩さん", "　太郎 君", "おばさん", "さん") == ["兄", "田中", "先輩", "田中", "太郎", "ば", "さん"]
    assert one(spark, N.is_title(A), "先生", "お兄様", "", "田中先生", "　") == [True, True, True, False, True]
    assert one(spark, N.is_family(A), "山田家", "家", "山田") == [True, False, False]
    assert one(spark, N.dst_base(A), "田中老师君", "君", "妹妹") == ["田中", "君", "妹妹"]
    assert one(spark, N.gender(A), "男", "動物", "null", "x", " ") == ["男性", "动物", None, None, None]
    m, f = N.gender_evidence(A)
    assert one(spark, F.concat_ws(",", m, f), "男性と女子", "彼女", "x") == ["7,5", "0,3", "0,0"]
    assert one(spark, N.alias_dst(F.lit("田中"), F.lit("田中"), A), "田中", "田中くん", "田中先生", "田中さん", "お田中") == ["田中", "田中君", "田中老师", "田中", "田中"]
    assert one(spark, N.info_gender(A), "田中,男性", "女性", "田中", "") == ["男性", "女性", None, None]
    assert one(spark, N.info_full(A), "田中,男性", "女性", "田中", "") == ["田中", None, "田中", None]
