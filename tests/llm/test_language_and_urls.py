import itertools
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from linewright.llm import language_id, queries, url_rules

from ..conftest import SF
from . import edge_cases


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_language_hierarchy(spark, sf).collect()
    assert len(got) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id][0] for r in own) >= 0.98 * len(own)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs, 100)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "123 ... 456"), (3, "é"), (4, "日本"), (5, "the of and that is"), (6, "the of and that is"), (7, "x " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2)) and all(got[i][0] != "und" for i in (3, 4, 5, 7)) and got[5] == got[6] and got[5][0] == "en"
    assert language_id.fit(edge_cases.empty(spark)) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    one = language_id.train(["the and of"], ["en"])
    assert [r.lang_pred for r in language_id.identify(odd.filter("doc_id = 5"), one).collect()] == ["en"]
    # lang, source and doc_id are no inputs of a prediction
    other = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "doc_id": F.col("doc_id") + 10**9})
    a = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert a == {r.doc_id - 10**9: r.lang_pred for r in language_id.identify(other, model).collect()}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    end = min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:end]


def brute_rule(host, path):
    fit = [(len(r), r, a) for a, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")) for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_urls(spark):
    sf = SF.replace("0.001", "0.01")
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op9_url_association_rules(spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r.page_id])
        rule, action = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (action is None or r.verdict == action)


def test_mined_rules(spark):
    bad = [(f"http://{h}.cheap.example/{k}", True) for h in ("a", "b") for k in range(60)]
    good = [(f"http://www.fine.example/{'x' if k % 2 else 'y'}/{k}.html", False) for k in range(300)]
    mixed = [(f"http://www.mixed.example/x/{k}.html", k % 3 == 0) for k in range(90)]
    labelled = spark.createDataFrame([*bad, *good, *mixed, (None, True), ("http://q", None)], "url string, block boolean")
    odd = [None, "", "no scheme", "HTTP://A.Cheap.Example/9?q#f", "http://", "x://h?q/en/", "http://www.mixed.example/x/1.html", "http://www.fine.example/x/1", "http://B.example.NET/en/x#y", "http://example.net", "a://b://c/d", "http://h/" + "p/" * 20_000]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(odd)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labelled).collect()}
    for i, u in enumerate(odd):
        assert (got[i].host, got[i].path) == split(u) and got[i].rule == brute_rule(*split(u))[0]
    assert got[3].verdict == "block" and [got[i].verdict for i in (0, 1, 2, 4, 6, 7, 8)] == ["allow"] * 7
    none = url_rules.judge_urls(pages, labelled.limit(0)).collect()
    assert len(none) == len(odd) and {r.verdict for r in none if r.rule is None} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), labelled).count() == 0


def brute_rules(rows, limits):
    """All rules that the limits let through, by counting every combination of every url's tokens."""
    seen, bad = Counter(), Counter()
    for url, block in rows:
        tokens = sorted(url_rules.url_tokens(url))
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(tokens, k):
                seen[part] += 1
                bad[part] += block
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    found = {}
    for part, m in seen.items():
        for block, urls, rate in ((True, bad[part], base), (False, m - bad[part], 1 - base)):
            c, z = urls / m, limits.errors
            lower = (c + z * z / (2 * m) - z * math.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if urls >= limits.min_urls and (c - rate) / (1 - rate) >= limits.min_certainty and lower > rate:
                found[part, block] = (c - rate) / (1 - rate)
    return {(p, b) for (p, b), c in found.items() if not any(found.get((p[:k] + p[k + 1 :], b), -1) >= c - 1e-12 for k in range(len(p)))}


def test_rules_of_the_tables_against_brute_force(spark):
    sf = SF.replace("0.001", "0.1")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    labelled = url_rules.labelled_pages(pages, spark.read.parquet(f"{sf}/labels.parquet"))
    limits = url_rules.MiningLimits()
    mined = url_rules.mine(labelled, limits).collect()
    wanted = brute_rules([(r.url, r.block) for r in labelled.collect()], limits)
    assert {(tuple(r.tokens), r.block) for r in mined} == wanted and {b for _, b in wanted} == {True, False}
    # Either way of matching gives the same verdicts, and rules decide some of each kind.
    got = [tuple(r) for r in url_rules.judge_urls(pages, labelled).collect()]
    joined = [tuple(r) for r in url_rules.judge_urls(pages, labelled, rules_sent=0).collect()]
    assert sorted(got, key=str) == sorted(joined, key=str)
    known = url_rules.build_index([url_rules.MinedRule(frozenset(r.tokens), r.block, r.certainty, r.urls) for r in mined])
    fits = Counter(r.block for p in pages.collect() for r in [x for t in url_rules.url_tokens(p.url) for x in known.get(t, ())] if r.tokens <= set(url_rules.url_tokens(p.url)))
    assert fits[True] and fits[False] and Counter(v for *_, rule, v in got if rule is None)["block"]


def test_limits_hold_at_every_size_and_mix(spark):
    """A host with few labels among many, and labels that mostly block."""
    rare = [(f"http://bad.example/{k}", True) for k in range(40)]
    many = [(f"http://h{k % 50}.fine.example/{k % 7}/{k}", k % 5 == 0) for k in range(20_000)]
    toxic = [(f"http://h{k % 50}.most.example/{k}", k % 10 != 0) for k in range(2_000)] + [(f"http://good.example/{k}", False) for k in range(100)]
    pages = spark.createDataFrame([(0, "http://bad.example/x"), (1, "http://h1.fine.example/1/x"), (2, "http://good.example/1/x"), (None, None), (0, "http://bad.example/x")], "page_id long, url string")
    verdicts = lambda rows: [r.verdict for r in url_rules.judge_urls(pages, spark.createDataFrame(rows, "url string, block boolean")).orderBy("page_id").collect()]
    assert verdicts(rare + many) == ["allow", "block", "block", "allow", "allow"]
    assert verdicts(toxic)[-1] == "allow"
    assert set(verdicts(rare)) == {"allow"}


def test_repeated_rows_and_null_ids(spark):
    docs = edge_cases.repeated(spark)
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} == {"en", "und"}
    twice = spark.createDataFrame([(1, "http://a.example/x")] * 3 + [(None, "http://a.example/x"), (None, None)], "page_id long, url string")
    judged = url_rules.judge_urls(twice, spark.createDataFrame([], "url string, block boolean")).collect()
    assert len(judged) == 5 and {r.verdict for r in judged} == {"allow"}
