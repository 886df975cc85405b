import re
from collections import Counter, defaultdict

from linewright.llm import line_quality, queries

from ..conftest import SF
from . import edge_cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


def brute_kept(rows, limits):
    lines = lambda t: [" ".join(re.sub(r"[0-9]", "0", w).translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(x)) for x in (t or "").split("\n")]
    docs, first, hosts = defaultdict(set), {}, defaultdict(set)
    for i, t, h in rows:
        hosts[h].add(t or "")
        for x in filter(None, lines(t)):
            docs[h, x].add(t)
            first[h, x] = min(first.get((h, x), i), i)
    out = {}
    for i, t, h in rows:
        n = len(WORD.findall(t or ""))
        gone = sum(len(x.split(" ")) for x in filter(None, lines(t)) if len(docs[h, x]) > limits.max_documents and len(docs[h, x]) > limits.max_share * len(hosts[h]) and first[h, x] != i)
        out[i] = not expected(t)[-1] and n - gone >= limits.min_left_share * n and n - gone >= limits.min_words
    return out


def check(df, docs, limits=line_quality.LineLimits()):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    got = {r.doc_id: r for r in df.collect()}
    kept = brute_kept(rows, limits)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected(t), (i, (t or "")[:80])
        assert r.kept == kept[i], i
    return got


def test_whole_table(spark):
    check(queries.op1_line_frequency(spark, SF), spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(spark):
    docs = edge_cases.frame(spark)
    check(line_quality.line_verdicts(docs), docs)
    assert line_quality.line_verdicts(edge_cases.empty(spark)).count() == 0
    assert line_quality.clean_lines(docs).columns == docs.columns


def test_common_lines_are_removed(spark):
    body = lambda i: " ".join(f"own{i}x{k}" for k in range(40))
    notice = "Read all 12 of our terms before you go on to the next page of this site please"
    rows = [(i, f"{body(i)}\n{notice.upper() if i % 2 else notice}", "s", "h") for i in range(30)] + [(i, f"{notice}\nend of {i}", "s", "h") for i in range(30, 35)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = line_quality.LineLimits(max_documents=20)
    got = check(line_quality.line_verdicts(docs, limits), docs, limits)
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(30, 35))
    left = {r.doc_id: r.text for r in line_quality.clean_lines(docs, limits).collect()}
    assert left == {0: rows[0][1]} | {i: body(i) for i in range(1, 30)}


def test_common_lines_are_removed_from_large_hosts(spark):
    own = "array_join(transform(sequence(1, 12), k -> translate(concat(id, 'x', k), '0123456789', 'abcdefghij')), ' ')"
    notice = "this shared line has some words that only some of them hold"
    docs = spark.range(30_000, numPartitions=4).selectExpr("id AS doc_id", f"if(id < 28, concat('{notice}\\n', {own}), {own}) AS text", "'en' AS lang", "'hot' AS source")
    changed = line_quality.line_verdicts(docs).filter("n_removed_words > 0")
    assert sorted(r.doc_id for r in changed.collect()) == list(range(1, 28))


def test_repeated_rows_and_ids(spark):
    """Equal rows count once and lose their words once; an id with several texts is judged text by text."""
    body = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    notice = "one shared line of these seven words"
    rows = [(i, f"{body(i)}\n{notice}", "s") for i in range(25)] * 3 + [(25, f"{body(25)}\n{notice}", "s")] * 10 + [(25, "too short", "s"), (25, f"{notice}\nanother text", "s"), (None, f"{body(99)}\n{notice}", "s"), (None, "too short", None)]
    docs = spark.createDataFrame([(i, t, "en", h, 1) for i, t, h in rows], "doc_id long, text string, lang string, source string, row_key long")
    got = line_quality.line_verdicts(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): (r.kept, r.n_removed_words) for r in got}
    assert by == {(0, 67): (True, 0)} | {(i, 67): (True, 7) for i in [*range(1, 26), None]} | {(25, 2): (False, 0), (25, 9): (False, 7), (None, 2): (False, 0)}
    left = sorted((str(r.doc_id), r.text) for r in line_quality.clean_lines(docs).collect())
    kept = [(0, rows[0][1])] * 3 + [(i, body(i)) for i in range(1, 25)] * 3 + [(25, body(25))] * 10 + [(None, body(99))]
    assert left == sorted((str(i), t) for i, t in kept)
    odd = edge_cases.repeated(spark)
    assert line_quality.line_verdicts(odd).count() == odd.count() and line_quality.clean_lines(odd).columns == odd.columns
