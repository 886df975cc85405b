import random
import re

from linewright.llm import components, metric_join, queries

from ..conftest import SF
from . import edge_cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    points = {}
    for i, t in rows:
        points.setdefault(sets_of(t), []).append(i)
    sets = [s for s in points if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(sets):
        least[find(k)] = min(least.get(find(k), 1 << 60), *points[s])
    out = {i: (0, i) for i in points.get(frozenset(), [])}
    for k, s in enumerate(sets):
        out |= {i: (len(s), least[find(k)]) for i in points[s]}
    return out


def check(df, rows):
    got = [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == len(rows)
    assert {i: (n, c) for i, n, c in got} == brute(rows)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_whole_table(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        check(queries.op4_metric_join(spark, sf), rows_of(spark.read.parquet(f"{sf}/documents.parquet")))


def test_edges(spark):
    docs = edge_cases.frame(spark)
    check(metric_join.jaccard_components(docs), rows_of(docs))
    assert metric_join.jaccard_components(edge_cases.empty(spark)).count() == 0
    assert metric_join.keep_first_of_each(docs).columns == docs.columns


def test_chains_variants_and_shared_passages(spark):
    """Distances around the threshold, chains through several documents, a passage that many share."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=55)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(20, 160))
        for _ in range(rng.randint(1, 12)):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 45))):
                v[rng.randrange(len(v))] = rng.choice(words)
            if rng.random() < 0.4:
                base = v
            texts.append(" ".join(v))
    texts += [" ".join(rng.choices(words, k=20) + passage + rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(metric_join.jaccard_components(docs), list(enumerate(texts)))


def test_repeated_rows_and_ids(spark):
    """Rows of one doc_id are one document; equal rows get equal answers."""
    rows = edge_cases.repeated_rows()
    got = [tuple(r) for r in metric_join.jaccard_components(edge_cases.repeated(spark)).collect()]
    n = lambda t: len(sets_of(t))
    # 1 holds two texts, which link it with 2, 6 and 7 and with 3; rows without an id lend none.
    component = lambda i, t: 1 if i in (1, 2, 3, 6, 7) or t == edge_cases.BASE else i
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted([(i, n(t), component(i, t)) for i, t, _ in rows], key=order)
    kept = [r.doc_id for r in metric_join.keep_first_of_each(edge_cases.repeated(spark)).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5] and kept.count(None) == 4


def test_large_group_of_near_copies(spark):
    """Points at like distances from each other, more than one level, cells of several pivots."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for size, length, edits in ((300, 120, 5), (200, 60, 2), (60, 300, 9)):
        base = rng.choices(words, k=length)
        for _ in range(size):
            v = list(base)
            for _ in range(rng.randint(0, edits)):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(metric_join.jaccard_components(docs), list(enumerate(texts)))


def test_links_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    """A group with few pivots, as in a large table: of the links between all near copies few are passed on."""
    monkeypatch.setattr(metric_join, "PIVOTS", 2)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base, texts = rng.choices(words, k=160), []
    for _ in range(500):
        v = list(base)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(len(v))] = rng.choice(words)
        texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signs = docs.select("doc_id", "text").mapInArrow(metric_join._signer(5), metric_join._SIGNS)
    links = metric_join.point_links(metric_join.linkable_points(docs, signs, 80, 5), 80)
    assert links.count() < 3 * len(texts)
    check(metric_join.jaccard_components(docs), list(enumerate(texts)))


def test_few_links_take_one_task(spark, monkeypatch):
    """Components by one task and by rounds, and pairs of sets by either plan, agree; few links are labelled without the rounds' shuffles."""
    rng = random.Random(2)
    pairs = [(rng.randint(-900, 900), rng.randint(-900, 900)) for _ in range(900)] + [(k, k + 1) for k in range(2000, 2400)] + [(-(1 << 63), (1 << 63) - 1), (7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    few, shuffles = components.connected(links), lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert not shuffles(few)
    got = sorted(tuple(r) for r in few.collect())
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert got == sorted(tuple(r) for r in components.connected(links).collect())
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        old = dict(root)
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if old == root:
            break
    assert got == sorted(root.items())
    assert components.connected(links.limit(0)).count() == 0
    points = spark.createDataFrame([(k, 4, [1, 2, 3, k]) for k in range(40)], "key long, n long, s array<long>")
    some = spark.createDataFrame([(5, 6, 1), (5, 7, 2), (4, 3, 3), (3, 4, 3)], "a long, b long, label_a long")
    found = []
    for most in (10, 0):
        monkeypatch.setattr(metric_join, "BROADCAST_ROWS", most)
        found.append(sorted(tuple(r) for r in metric_join._linked(some, points, 60).collect()))
    assert found[0] == found[1] == [(3, 4, 3), (4, 3, 3), (5, 6, 1), (5, 7, 2)]
