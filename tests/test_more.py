from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.operators import glossary as G
from linewright.operators import lines as L
from linewright.operators import rules as R
from linewright.plans import translation as TR
from linewright.sources import epub as EP
from linewright.sources import files as FL

from .test_operators import mentions_of


def test_lenient_json(spark):
    rows = ['{"a":1}', 'so:\n```json\n{"a":1}\n```', 'x {"a":1} y', "<think>{}</think>{\"a\":1}", "[1]", "none", "{broken"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, c string").orderBy("k").select(T.lenient_json(F.col("c"))).collect()]
    assert got == ['{"a":1}'] * 4 + [None] * 3


def test_bases_are_asked_again(spark):
    m = mentions_of(spark, [("田中", 1, "a"), ("林", 2, "b"), ("森", 3, "c"), ("先生", 4, "d")])
    answers = {("田中", 1): "タナカ", ("田中", 2): "田中", ("林", 1): "ハ", ("林", 2): "リ", ("林", 3): "リン", ("森", 1): "國", ("森", 2): "國", ("森", 3): "國"}
    asked = G.infer_bases(G.clusters(G.aliases(m, ["doc_id"]), ["doc_id"]), G.context_items(m, ["doc_id"]), ["doc_id"], lambda n, c, k: f'ok {{"is_name": true, "gender": "男", "translated_chinese_name": "{answers[n, k]}"}}')
    assert {(r.key, r.base, r.gender) for r in asked.collect()} == {("田中", "田中", "男"), ("森", "國", "男")}


def test_find_entries(spark):
    names = spark.createDataFrame([(1, "a.html"), (1, "t/b.html"), (1, "none"), (1, "c.html")], "k int, name string")
    listing = spark.createDataFrame([(1, "x/a.html"), (1, "a.html"), (1, "O/t/b.html"), (1, "p/c.html"), (1, "q/c.html")], "k int, entry string")
    assert {r.name: r.entry for r in EP.find_entries(names, listing, "k").collect()} == {"a.html": "a.html", "t/b.html": "O/t/b.html", "c.html": "p/c.html"}
    assert {r.name for r in EP.find_entries(names, listing, "k", unique=True).collect()} == {"a.html", "t/b.html"}


def test_driver_helpers():
    assert FL.endpoint_warnings("https://h/v1") == [] and FL.endpoint_warnings("http://localhost:1") == [] and len(FL.endpoint_warnings("http://u:p@h/?key=1")) == 3
    assert FL.work_files(["b_work", "b_output.json", "bb_output.json", "x"], "b") == ["b_output.json", "b_work"]


def test_retry_context(spark):
    lines = R.detect_lines(spark.createDataFrame([(1, k, f"line {k}") for k in range(1, 9)], "doc_id long, line_no long, line string"), R.SMALL_PACK)
    done = lines.filter("line_no = 4").select("doc_id", "line_no", F.upper("line").alias("dst"))
    failed = lines.filter("line_no = 5").select("doc_id", "line_no")
    got = TR.retry_context(lines, failed, done, TR.Settings(context_lines=2)).collect()
    assert [(r.line_no, r.context) for r in got] == [(5, "line 3\nLINE 4\nline 6\nline 7")]
    assert L.scan_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
