import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from linewright.llm import decontaminate, packing, secret_scan

from ..conftest import SF
from . import edge_cases
from .test_line_quality import brute_kept
from .test_metric_join import brute
from .test_packing import library


def table(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array(["en"] * len(rows)), "source": pa.array([r[2] for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [say(30) for _ in range(5)]
    texts = [say(rng.randint(20, 400)) for _ in range(40)]
    texts += [t for t in texts[:8]] + [re.sub(r"\bw1\d\b", "zz", t) for t in texts[8:14]]
    texts += [f"{say(40)} {items[k % 5]} {say(30)}" for k in range(7)] + [f"{say(60)} password=Abcdef{k}123456 {say(20)}" for k in range(6)] + ["short one", "", None, "a b c d e " * 30, say(6000)]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    pq.write_table(table(rows), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(5), pa.int64()), "text": items}), tmp_path / "benchmark.parquet")
    kept = brute_kept(rows, corpus_pipeline.line_quality.LineLimits())
    left = [(i, t) for i, t, _ in rows if kept[i]]
    heads = brute(left)
    left = [(i, t) for i, t in left if heads[i][1] == i]
    left = [(i, t) for i, t in left if not any(f" {x} " in f" {t} " for x in items)]

    def mask(t):
        for _, a, b in sorted(secret_scan.all_secrets(t)[1], key=lambda s: -s[1]):
            t = t[:a] + "[secret]" + t[b:]
        return t

    left = [(i, mask(t)) for i, t in left]
    sizes = dict(zip([i for i, _ in left], [len(x) + 1 for x in library([t for _, t in left])]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes and len(total) < 60
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= packing.MAX_LEN and len(used) <= -(-sum(sizes.values()) // packing.MAX_LEN) + 2


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    docs = edge_cases.frame(spark)
    docs.limit(0).select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (docs, edge_cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, data, str(tmp_path))
            assert out.dtypes == data.dtypes
            out.collect()
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, data, str(tmp_path)).columns


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = {r.doc_id for r in decontaminate.without_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(left) > 0.9 * len(rows)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_repeated_rows_and_null_ids(spark, tmp_path):
    edge_cases.empty(spark).select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    data = edge_cases.repeated(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        data = stage(spark, data, str(tmp_path)).cache()
        ids = [r.doc_id for r in data.collect()]
        if name == "quality":
            assert sorted(ids, key=str) == sorted([1, 1, 2, 3, 6, *[7] * 10, None], key=str)
        if name == "near_duplicates":
            assert sorted(ids, key=str) == sorted([1, None], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, data, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted([1, None], key=str) and len({(r.sequence_id, r.offset) for r in packed}) == 2
