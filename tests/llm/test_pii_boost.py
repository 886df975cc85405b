import hashlib
import random
import re

import numpy as np

from linewright.llm import pii_boost as P
from linewright.llm import queries

from ..conftest import SF
from . import edge_cases

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def check(df, rows):
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    n = 0
    for i, text in rows:
        want = brute(text)
        n += len(want)
        r = got[i]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in KINDS), (i, joined, (text or "")[:200])
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest(), (i, joined)
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {":".join(s) for s in spans} >= set(joined)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), int(s[1]), int(s[2])))
    return n


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_whole_table(spark):
    sf = SF.replace("0.001", "0.01")
    assert check(queries.op2_boosted_candidates(spark, sf), rows_of(spark.read.parquet(f"{sf}/documents.parquet"))) > 20


def test_edges(spark):
    docs = edge_cases.frame(spark)
    check(P.digest(P.find_personal_data(docs)), rows_of(docs))
    assert P.find_personal_data(edge_cases.empty(spark)).count() == 0
    rng = random.Random(2)
    odd = [
        "a@b.c_d@e.f..g@h.i", "a@b@c.d", "x..y@z-.q.", "1.2.3.4.5.6.7.8", "1.2.3.400", "0001.002.3.0255", "4" * 16, "4111 1111 1111 1111", "4111-1111 11111111", "4111  1111 1111 1111", "12 4111111111111111",
        "+1 (502) 555-6996 +44", "+1 2", "+123456789012345678", "++12345678", "é😀 a@b.cd 😀 10.0.0.1 é +12 345 678 90.", "\x01a@b.c\x01 1.2.3.4", "a" * 50_000, "1" * 50_000, "1." * 20_000, "a@b.c " * 500,
    ]
    odd += ["".join(rng.choices("a1 .-@+()4_:é\n", k=rng.randint(1, 120))) for _ in range(400)] + ["".join(rng.choices("0123456789 -.", k=60)) for _ in range(300)]
    rows = list(enumerate(odd))
    check(P.digest(P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))), rows)


def test_candidates_add_spans(spark):
    rows = [(0, "call 502-555-6996 now"), (1, "mail jane.roe [at] corp [dot] com please"), (2, "version 2024-1234-1234-1234"), (3, "card 378282246310005 ok"), (4, "host 2001:db8:85a3:1:2:8a2e:370:7334 is up"), (5, "nothing here")]
    got = {r.doc_id: r.spans for r in P.digest(P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0] == "phone:5:17" and got[1] == "email:5:33" and got[3] == "card:5:20" and got[4].startswith("ip:5:") and got[5] == ""
    masked = {r.doc_id: r.text for r in P.redact(spark.createDataFrame([*rows, (6, None), (7, "a@b.cd, é 1.2.3.4")], "doc_id long, text string")).collect()}
    assert masked[0] == "call [phone] now" and masked[6] is None and masked[7] == "[email], é [ip]" and masked[5] == "nothing here"


def test_features_agree_and_model_is_calibrated(spark):
    rows = [(k, m, b, a) for k, m, b, a in [(0, "a (at) b.c", "mail ", " x"), (1, "1:2:3:4:5:6:7:8", "=", "/a"), (2, "3782 822463 10005", "visa no. ", "."), (3, "(502) 555-6996", "x", "9")]]
    df = spark.createDataFrame(rows, "kind int, m string, before string, after string").selectExpr("struct(*) as c")
    got = df.selectExpr(*(f"cast({e} as double) as {n}" for n, e in P.features_sql("c").items())).collect()
    assert [[*map(float, r)] for r in got] == [[*map(float, P.features_of(*r))] for r in rows]
    x, y = P.examples(9000, seed=99)
    trees, limits = P.model()
    score = sum(P._predict(t, x) for t in trees)
    taken = score >= np.array(limits)[x[:, 0].astype(int)]
    assert (y[taken] == 1).mean() > 0.93 and taken[y == 1].mean() > 0.7
    for k, (kind, pattern, need) in enumerate(P.GENERATORS):
        own = x[:, 0] == k
        assert (y[taken & own] == 1).mean() > 0.9 and taken[own & (y == 1)].mean() > 0.5, (k, kind)


def test_generators_overlap_and_the_likeliest_stays(spark):
    rows = [
        "call 1-800-555-0199 today", "Tel. 01 23 45 67 89 please", "phone: 5551234567 now", "host 2001:db8::1 is up", "mail jane.roe at corp dot com please", "contact: jane @ corp . org", "reach 10[.]20[.]30[.]40 first",
        "visa no. 4111.1111.1111.1111 thanks", "call +1%%% (136) 555-7479%%% so", "the date 2024-05-17 and std::vector and 3 @ 4.50 each", "a@b.cd 10.0.0.1 +12 345 678 90",
    ]
    got = [r.spans for r in P.digest(P.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()]
    parts = [[(k, t[int(a) : int(b)]) for k, a, b in (x.split(":") for x in g.split(",") if x)] for t, g in zip(rows, got)]
    assert parts == [
        [("phone", "1-800-555-0199")], [("phone", "01 23 45 67 89")], [("phone", "5551234567")], [("ip", "2001:db8::1")], [("email", "jane.roe at corp dot com")], [("email", "jane @ corp . org")], [("ip", "10[.]20[.]30[.]40")],
        [("card", "4111.1111.1111.1111")], [("phone", "+1%%% (136) 555-7479")], [], [("email", "a@b.cd"), ("ip", "10.0.0.1"), ("phone", "+12 345 678 90")],
    ]


def test_very_many_matches_and_repeated_rows(spark):
    import time

    many = "a@b.cd 10.0.0.1 call 502-555-6996 now; " * 20_000
    df = spark.createDataFrame([(1, many), (1, many), (None, "call 502-555-6996 now"), (2, None)], "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.n_email, r.n_ip, r.spans.count("phone")) for r in P.digest(P.find_personal_data(df)).collect()}
    assert got == {(1, 20_000, 20_000, 20_000), (None, 0, 0, 1), (2, 0, 0, 0)} and time.time() - began < 60
