import random

import numpy as np

from linewright.llm import decontaminate as D
from linewright.llm import queries

from ..conftest import SF
from . import edge_cases


def words(text):
    out = []
    for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" "):
        for x in w.replace("\n", " ").split(" "):
            x = "".join(c for c in x if c.isascii() and c.isalnum() or not c.isascii())
            if x:
                out.append(x)
    return out


def distance(item, doc):
    """Fewest edits of item to any part of doc."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(doc, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_whole_table(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        got = {(r.doc_id, r.item_id) for r in queries.op5_cgk_decontamination(spark, sf).collect()}
        exact = {(i, k) for i, d in docs for k, t in items if f" {' '.join(t)} " in f" {' '.join(d)} "}
        assert exact and exact <= got
        by_doc, by_item = dict(docs), dict(items)
        assert all(distance(by_item[k], by_doc[i]) <= int(len(by_item[k]) * D.MAX_EDITS) for i, k in got - exact)


def test_recall_by_edits(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(14, 60)))) for k in range(40)]
    docs, planted = [], {}
    for i in range(400):
        k, text = rng.choice(items)
        own = text.split()
        share = rng.choice([0.0, 0.05, 0.1])
        for _ in range(int(share * len(own))):
            at = rng.randrange(len(own))
            what = rng.random()
            own[at : at + 1] = [rng.choice(vocabulary)] if what < 0.5 else [] if what < 0.75 else [own[at], rng.choice(vocabulary)]
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 90)) + [w.upper() + "," for w in own] + rng.choices(vocabulary, k=rng.randint(0, 90)))))
        planted[i] = k
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=120))) for i in range(200)]
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=700)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert sum((i, k) in got for i, k in planted.items()) >= 0.97 * len(planted)
    assert all(i < 1000 for i, _ in got)
    by_doc, by_item = dict(docs), dict(items)
    for (i, k), r in list(got.items())[:120]:
        assert r.edits == distance(words(by_item[k]), words(by_doc[i]))
        assert distance(words(by_item[k]), words(by_doc[i])[r.first_word : r.end_word]) == r.edits


def test_no_item_within_its_edits_is_missed(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    items, docs, planted = [], [], set()
    for n in (*range(8, 21), 25, 40):
        for share in (0, D.MAX_EDITS):
            for _ in range(30):
                k, own = len(items), rng.choices(vocabulary, k=n)
                items.append((k, " ".join(own)))
                for at in sorted(rng.sample(range(n), int(n * share)), reverse=True):
                    what = rng.random()
                    own[at : at + 1] = [rng.choice(vocabulary)] if what < 0.5 else [] if what < 0.75 else [own[at], rng.choice(vocabulary)]
                docs.append((k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 0, 30])) + own + rng.choices(vocabulary, k=rng.choice([0, 30])))))
                planted.add((k, k))
    # The beginning is cut off at a document's start.
    items.append((len(items), " ".join(vocabulary[:20])))
    docs.append((len(docs), " ".join(vocabulary[4:20])))
    planted.add((len(docs) - 1,) * 2)
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert planted <= {(r.doc_id, r.item_id) for r in found}
    by_doc, by_item = dict(docs), dict(items)
    assert all(r.edits == distance(words(by_item[r.item_id]), words(by_doc[r.doc_id])) for r in found)


def test_edges(spark):
    docs, items = edge_cases.frame(spark), spark.createDataFrame([(1, edge_cases.BASE), (2, None), (3, ""), (4, "unfindable short"), (None, "a b c d e f g"), (6, "one TWO three and")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    assert {i for i, k in got if k == 1} == {i for i, t in enumerate(edge_cases.TEXTS) if t and t.lower().startswith("word0 ")}
    assert D.find_leaks(edge_cases.empty(spark), items).count() == 0
    assert D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.without_leaks(docs, items).columns == docs.columns


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, doc = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 16))
        edits, a, b = D.align(item, doc)
        assert edits == distance(list(item), list(doc)) == (distance(list(item), list(doc[a:b])) if b > a else len(item))


def test_repeated_rows_and_null_ids(spark):
    docs = edge_cases.repeated(spark)
    items = spark.createDataFrame([(None, edge_cases.BASE), (-1, edge_cases.BASE), (7, "tiny"), (7, "tiny")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()), key=str)
    holds = [i for i, t, _ in edge_cases.repeated_rows() if t and t.startswith("word0")]
    assert got == sorted(((i, k) for i in holds for k in (None, -1)), key=str)
    # Short items are looked for where they are asked for.
    tiny = spark.createDataFrame([(1, "some tiny thing"), (2, "other")], "doc_id long, text string")
    assert D.find_leaks(tiny, items).count() == 0 and sorted(r.doc_id for r in D.find_leaks(tiny, items, min_letters=1).collect()) == [1, 1]
