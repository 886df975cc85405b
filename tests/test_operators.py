import json
import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import context as C
from linewright.operators import entities as E
from linewright.operators import glossary as G
from linewright.operators import lines as L
from linewright.operators import prompts as P
from linewright.operators import quality as Q
from linewright.operators import rules as R


def pack(*categories, **boundaries):
    return R.RulePack.parse(json.dumps({"boundaries": boundaries, "categories": list(categories)}))


def test_pack_forms_and_defaults():
    p = pack({"id": "a", "base_weight": 4, "match": {"keywords": ["x", {"text": "y", "weight": 7}, {"no": 1}], "regex": ["z+", {"pattern": "(", "weight": 1}]}}, {"id": "b"}, scene_break_regex=["^-+$", "("])
    a, b = p.categories
    assert a.keywords == (("x", 4.0), ("y", 7.0)) and a.regexes == (("z+", 4.0),) and (a.label, a.priority) == ("a", 3) and b.keywords == () and p.boundaries.scene_break == ("^-+$",)
    with pytest.raises(KeyError):
        R.RulePack.parse("{}")


def test_keywords_longest_and_other_categories():
    m = R.Matcher(pack({"id": "a", "match": {"keywords": ["彼", "彼女"]}}, {"id": "b", "match": {"keywords": ["彼"]}}))
    assert [(x.category, x.text, x.start) for x in m.keywords("彼女と彼")] == [("b", "彼", 0), ("a", "彼女", 0), ("a", "彼", 9), ("b", "彼", 9)]


def test_dedupe():
    p = pack({"id": "a", "match": {"keywords": ["bc", "abc"], "regex": ["abcd", "b"]}})
    m = R.Matcher(p)
    kept = R.deduped(m.keywords("abcd abcd") + m.patterns("abcd abcd"))
    assert [(x.text, x.start, x.kind) for x in kept] == [("abcd", 0, "regex"), ("abc", 5, "keyword"), ("b", 1, "regex")]


def test_initial_bonus_counts_bytes():
    p = pack({"id": "discourse_contrast", "base_weight": 10, "match": {"keywords": ["だが"]}})
    weight = lambda line: R.Matcher(p).detect(line, "narration")[0][0].weight
    assert [weight(x) for x in ("だが", "あだが", "ああだが", "「　だが", "a" * 5 + "だが", "a" * 6 + "だが")] == [14.0, 14.0, 10.0, 14.0, 14.0, 10.0]


def test_short_dialogue_and_reaction():
    p = pack({"id": "dialogue_reaction", "label": "r", "match": {"keywords": ["え"]}})
    m = R.Matcher(p)
    assert m.detect("え", "narration")[0] == [] and m.detect("「え」", "dialogue")[0][0].text == "え"
    assert m.detect("「短い」", "dialogue")[0][0].text == "(short_dialogue)" and m.detect("「」", "dialogue")[0] == [] and m.detect("「開いたまま", "dialogue")[0] == []


def test_dominant_by_priority_cap_and_name():
    p = pack({"id": "a", "label": "A", "priority": 2, "base_weight": 500, "match": {"keywords": ["x"]}}, {"id": "b", "label": "B", "priority": 3, "base_weight": 1, "match": {"keywords": ["y"]}}, {"id": "c", "label": "C", "priority": 2, "base_weight": 90, "actions": {"reset_context": True}, "match": {"keywords": ["z"]}})
    m = R.Matcher(p)
    assert m.detect("xy", "narration")[1] == "B" and m.detect("xz", "narration")[1:] == ("C", True, False)


def test_line_types(spark):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(["", "　", "◆◆◆", "第3章 始まり", "「はい」", "本文", "ISBN 1"], 1)], "doc_id long, line_no long, line string")
    assert [r[0] for r in rows.orderBy("line_no").select(L.line_type(F.col("line"))).collect()] == ["blank", "blank", "scene_break", "chapter_heading", "dialogue", "narration", "metadata"]


def test_context_against_loops(spark):
    rng = random.Random(3)
    parts = ["彼女", "と言っ", "らしい", "てくれ", "昨日", "田中さん", "アレクサンダ", "本文", "「え」", "しかし"]
    texts = {d: [rng.choice(["", "◆◆◆", "「"]) * (rng.random() < 0.3) + "".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 90))] for d in range(6)}
    lines = spark.createDataFrame([(d, k, x) for d, ls in texts.items() for k, x in enumerate(ls, 1)], "doc_id long, line_no long, line string")
    size, window, k = 7, 12, 3
    detected = R.detect_lines(lines, R.SMALL_PACK)
    got = {}
    for r in C.select_context(detected, size, window, k).collect():
        got.setdefault((r.doc_id, r.batch_id), {})[r.line_no] = round(r.score, 9)
    rows = {(r.doc_id, r.line_no): r for r in detected.withColumns({**L.features(F.col("line")), **{f"need_{n}": c for n, c in C.line_needs().items()}}).collect()}
    want = {}
    for d, ls in texts.items():
        for b in range(-(-len(ls) // size)):
            start, end = b * size + 1, min(len(ls), (b + 1) * size)
            resets = [i + 1 for i in range(1, start) if rows[d, i].reset]
            low, high = max(resets[-1] if resets else 1, start - window), start - 1
            needs = {n for n in C.NEEDS for i in range(start, end + 1) if rows[d, i][f"need_{n}"]}
            score = {i: 1 / (start - i) + (0.6 if i >= start - 2 else 0) for i in range(low, high + 1)}
            if "dialogue_prev" in needs:
                said = [i for i in score if rows[d, i].dialogue]
                if said:
                    score[said[-1]] += 3
                for i in said:
                    score[i] += i >= high - 6
            for i in score:
                f = rows[d, i]
                if "antecedent" in needs and i >= high - 20:
                    score[i] += 2.2 * f.name_hint + 1.2 * f.katakana_long
                if needs & {"anchor", "source"} and i >= high - 25:
                    score[i] += 1.6 * f.speech_verb + 1.4 * f.time_anchor
                if "relationship" in needs and i >= high - 15:
                    score[i] += 1.0 * f.name_hint
                if i == start - 1:
                    score[i] += 2
            best = sorted(score, key=lambda i: (-round(score[i], 9), -i))[:k]
            if best:
                want[d, b] = {i: round(score[i], 9) for i in best}
    assert got.keys() == want.keys()
    assert all(got[x].keys() == want[x].keys() and all(abs(got[x][i] - want[x][i]) < 1e-6 for i in got[x]) for x in want)


def test_checks(spark):
    cases = [
        ("ja", "こんにちは", "你好", 0, "NONE"), ("ja", "「く」の字形", "く字形", 0, "NONE"), ("ja", "これはペンです", "这是ペン", 3, "KANA_RESIDUE"), ("ja", "東京都", "東京都", 0, "HIGH_SIMILARITY"), ("ja", "東京都", "東京都", 3, "NONE"),
        ("ja", "第１２話です始まりの", "开始了吧朋友们", 0, "LENGTH_MISMATCH"), ("ja", "第１２話", "第12话", 0, "NONE"), ("ja", "……！", "", 0, "EMPTY_TRANSLATION"), ("ja", "！？", "あ", 0, "NONE"), ("ko", "안녕하세요", "你好안", 0, "HANGEUL_RESIDUE"),
        ("ja", "長い文章がここにある", "ab" * 20, 0, "DEGRADATION"), ("ja", "長い文章がここにあるのです", "好的好吧", 0, "NONE"), ("ja", "普通の文", '{"1":"a"}{"2":"b"}{"3":"c"}', 0, "JSON_STRUCTURE_ERROR"), ("en", "abcdefgh", "abcdefgh", 0, "HIGH_SIMILARITY"),
    ]
    for lang in ("ja", "ko", "en"):
        own = [(k, s, d, n, e) for k, (x, s, d, n, e) in enumerate(cases) if x == lang]
        rows = spark.createDataFrame([(k, 0, s, d, n) for k, s, d, n, _ in own] + [(k, 1, "好的", "行", 0) for k, *_ in own], "b int, i int, src string, dst string, retry_count int")
        got = {r.b: r.error for r in Q.check_pairs(rows, ["b"], lang, "zh").filter("i = 0").collect()}
        assert got == {k: e for k, *_, e in own}
    alone = spark.createDataFrame([(1, "a", " ", 0), (2, "a", "b", 0), (2, "b", None, 0)], "b int, src string, dst string, retry_count int")
    assert sorted((r.b, r.error) for r in Q.check_pairs(alone, ["b"], "en", "zh").collect()) == [(1, "FAIL_PARSE"), (2, "FAIL_LINE_COUNT"), (2, "FAIL_LINE_COUNT")]


def test_buckets_and_report(spark):
    rows = spark.createDataFrame([(1, "（良い）文章", "(好)"), (2, "漢字あり文", "啊ッ！"), (3, "東京都", "東京都"), (4, "良い文", "好")], "b int, src string, dst string").withColumn("retry_count", F.lit(0))
    got = Q.check_fix_recheck(rows, ["b"], "ja", "zh")
    assert {r.b: r.bucket for r in got.collect()} == {1: "auto_fix", 2: "fixed", 3: "failed", 4: "none"}
    assert {r.bucket: r.counts_as_error for r in Q.error_report(got).collect()} == {"auto_fix": False, "fixed": True, "failed": True}
    blocks = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, " ")], "i int, dst string")
    assert {r.status: r.n for r in Q.stage_summary(blocks, blocks.filter("i in (1, 2)"), ["i"]).collect()} == {"translated": 1, "failed": 1, "pending": 2}


def parse(spark, text, expected):
    r = P.parse_responses(spark.createDataFrame([(1, text, expected)], "k int, response string, expected long"), ["k"]).first()
    return dict(r.translations), list(r.missing), list(r.duplicate), list(r.out_of_range), list(r.malformed)


def test_parsing(spark):
    assert parse(spark, '{"1":"你好"}\n{"2":"谢谢"}', 2) == ({1: "你好", 2: "谢谢"}, [], [], [], [])
    assert parse(spark, "<think>x\n{\"1\":\"no\"}</think>{1:'a'}\n\n{'2': \"b\\nc\"}", 2) == ({1: "a", 2: "b\nc"}, [], [], [], [])
    assert parse(spark, '{"1":"a"}\n{"1":"b"}\nrubbish\n{"9":"x"}\n{"0":"y"}\n[1]\n{"3":4}\n{"2":null}', 4) == ({1: "b", 3: "4", 2: "null"}, [4], [1], [0, 9], ["rubbish", "[1]"])
    assert parse(spark, "", 2) == ({}, [1, 2], [], [], []) and parse(spark, None, 1)[1] == [1] and parse(spark, "x", 0)[1] == []


def test_prompt_round_trip(spark):
    odd = ['a"b', "back\\slash", "tab\there", "plain", "{\"1\":\"x\"}", "日本"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(odd, 1)], "b int, n long, t string")
    jsonl = P.numbered_jsonl(rows, ["b"], "n", "t")
    assert parse(spark, jsonl.first().jsonl, len(odd))[0] == dict(enumerate(odd, 1))
    one = jsonl.select(P.layered_prompt(F.lit("ctx"), F.lit("terms"), F.lit("J")).alias("a"), P.layered_prompt(F.lit(""), F.lit(None).cast("string"), F.lit("J")).alias("b"), P.template_prompt(F.lit("{{input}}"), F.lit("g"), F.lit("J")).alias("c")).first()
    assert one.a == f"ctx\n\nterms\n{P.INSTRUCTIONS[True, True]}J\n" and one.b == f"{P.INSTRUCTIONS[False, False]}J\n" and one.c.count("J") == 2
    entries = spark.createDataFrame([(2, "b", "乙", ""), (1, "c", "丙", "男性"), (3, "a", "", "")], "position long, src string, dst string, info string")
    assert P.glossary_text(entries).first()[0] == "c -> 丙   #男性\nb -> 乙   #" and P.glossary_text(entries, True).first()[0] == "Terms:\nb→乙\nc→丙\n" and P.glossary_text(entries.filter("dst = ''"), True).first()[0] is None


def test_bio(spark):
    labels = "I-PER B-PER I-PER I-LOC I-PER B-PER B-LOC O I-LOC B-PER I-PER".split()
    rows = spark.createDataFrame([(1, k, chr(97 + k), x, float(k), k, k + 1) for k, x in enumerate(labels)], "d int, pos int, token string, label string, score double, start int, end int")
    got = sorted((r.start, r.end, r.text, r.label, r.score) for r in E.decode_bio(rows, ["d"]).collect())
    assert got == [(1, 3, "bc", "PER", 1.5), (5, 6, "f", "PER", 5.0), (6, 7, "g", "LOC", 6.0), (9, 11, "jk", "PER", 9.5)]


def test_merge_is_a_fold_of_means(spark):
    rows = spark.createDataFrame([(1, "a", "P", 0, 1, 1.0), (1, "b", "P", 1, 2, 0.0), (1, "c", "P", 2, 3, 0.0), (1, "d", "L", 3, 4, 1.0), (1, "e", "L", 5, 6, 1.0)], "d int, text string, label string, start int, end int, score double")
    got = sorted((r.start, r.end, r.text, r.label, r.score) for r in E.merge_adjacent(rows, ["d"]).collect())
    assert got == [(0, 3, "abc", "P", 0.25), (3, 4, "d", "L", 1.0), (5, 6, "e", "L", 1.0)]
    people = spark.createDataFrame([("PER", 0.9), ("B-PERSON", 0.95), ("PER", 0.89), ("LOC", 0.99)], "l string, s float").select(E.is_person(F.col("l"), F.col("s"))).collect()
    assert [r[0] for r in people] == [True, True, False, False]
    vocabulary = F.create_map(F.lit("a"), F.lit(5), F.lit("c"), F.lit(7))
    ids = spark.range(1).select(E.encode_characters(F.lit("abca"), vocabulary, 4)).first()[0]
    assert [(x.pos, x.id) for x in ids] == [(0, 5), (2, 7)]


def test_frames(spark):
    rows = spark.createDataFrame([(1, k, f" l{k} ") for k in range(1, 4)], "doc_id long, line_no long, line string")
    got = {r.line_no: (r.above, r.follow) for r in L.neighbours(rows, 2).collect()}
    assert got[1] == (["", ""], ["l2", "l3"]) and got[3] == (["l1", "l2"], ["", ""])


def mentions_of(spark, rows):
    return spark.createDataFrame([(1, name, no, line, ["", "above"], ["follow", ""]) for name, no, line in rows], "doc_id long, name string, line_no long, line string, above array<string>, follow array<string>")


def test_clusters(spark):
    m = mentions_of(spark, [("田中", 1, "本名は田中"), ("田中さん", 2, "x"), ("田中さん", 3, "x"), ("花姉さん", 4, "女性だ"), ("花君", 5, "男性だ"), ("花君", 6, "男性だ"), ("花", 7, "x")])
    got = {r.name: r for r in G.clusters(G.aliases(m, ["doc_id"]), ["doc_id"]).collect()}
    assert got["田中"].key == got["田中さん"].key == "田中" and got["田中"].primary == "田中" and got["田中さん"].alias_rank == 1
    assert got["花君"].part == 0 and got["花姉さん"].part == 1 and got["花"].part == 0 and got["花"].primary == "花君"
    bases = spark.createDataFrame([(1, "田中", 0, "田中", "男", None), (1, "花", 0, "花", "男性", "花子"), (1, "花", 1, "ハナ", None, None)], "doc_id long, key string, part int, base string, gender string, full_name string")
    entries = {r.src: (r.dst, r.info) for r in G.build_glossary(G.clusters(G.aliases(m, ["doc_id"]), ["doc_id"]), bases, ["doc_id"]).collect()}
    assert entries == {"田中": ("田中", ""), "田中さん": ("田中", ""), "花君": ("花君", "花子,男性"), "花": ("花", "花子,男性")}


def test_audit(spark):
    rows = spark.createDataFrame([("田中", "田中", "男性"), ("田中さん", "田中君", "男性"), ("林", "林", ""), ("林", "森", ""), ("王", "王", ""), ("王", "王", ""), ("先生", "老 师", ""), ("花", "ハナ", "女性"), ("花さん", "", "")], "src string, dst string, info string")
    assert tuple(G.audit_counts(rows).first()) == (9, 1, 1, 1, 1)
    assert [tuple(r) for r in G.duplicate_conflicts(rows).collect()] == [("林", 2, 2)]
    assert {r.key: r.kind for r in G.cluster_conflicts(rows).collect()} == {"田中": "variant", "林": "conflict", "花": "conflict"}
    ordered = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("d", F.lit(1))
    assert {r.src: r.info for r in G.propagate_gender(ordered, ["d"], "at").filter("src like '花%'").collect()} == {"花": "女性", "花さん": "女性"}
    chars = spark.createDataFrame([("田中", 3), ("田中さん", 2), ("先生", 1), ("山田家", 1)], "name string, count long")
    assert tuple(G.name_quality(chars).first()) == (4, 7, 1, 1, 0, 1)
