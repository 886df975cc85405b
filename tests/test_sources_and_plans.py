import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.operators import markup as M
from linewright.plans import translation as TR
from linewright.sources import epub as EP
from linewright.sources import files as FL
from linewright.streaming import batcher as B

from .conftest import SF

PAGE = '<html><body><p>One<br/>and <b>a</b><p id="x"> Two &amp; <ruby>漢<rt>kan</rt></ruby></p><div><p>In</p>loose</div><ul><li>a<li>b</ul><script>"<p>no</p>"</script></body></html>'


def test_leaf_blocks(spark):
    got = [(i, tag, text) for i, tag, text, *_ in M.leaf_blocks(PAGE)]
    assert got == [(0, "p", "Oneand a"), (1, "p", "Two & 漢"), (2, "p", "In"), (3, "li", "a"), (4, "li", "b")]
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "no blocks")], "k int, html string")
    assert [(r.k, r["index"], r.text) for r in M.html_blocks(rows, "k").orderBy("index").collect()] == [(1, i, t) for i, _, t in got]


def test_write_back(spark):
    page = "<p>  One</p>\n<p>Two</p><p>One</p>"
    assert M.written_back(page, {0: "<1>", 2: "3"}) == "<p>  &lt;1&gt;</p>\n<p>Two</p><p>3</p>"
    two = M.written_back(page, {0: "eins", 1: "zwei"}, "bilingual", "1em")
    assert two.count(M.MARKER) == 2 and [t for _, _, t, *_ in M.leaf_blocks(two)] == ["One", "Two", "One"] and "margin-top:1em" in two
    again = M.written_back(two, {0: "uno", 1: "due"}, "bilingual")
    assert again.count(M.MARKER) == 2 and "eins" not in again and "uno" in again and "margin-top" not in again
    assert "evil" not in M.written_back(page, {0: "x"}, "bilingual", '1em" evil="')
    toc = M.written_back('<li><a href="x">A</a></li>', {0: "B"}, "toc")
    assert toc == '<li><a href="x">A / B</a></li>' and M.written_back(toc, {0: "B"}, "toc") == toc
    done = M.write_back(spark.createDataFrame([(1, page), (2, "<p>z</p>")], "k int, html string"), spark.createDataFrame([(1, 1, "deux")], "k int, index int, dst string"), "k")
    assert {r.k: r.html for r in done.collect()} == {1: "<p>  One</p>\n<p>deux</p><p>One</p>", 2: "<p>z</p>"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab <>&é", min_size=1, max_size=6).filter(str.strip), min_size=1, max_size=5), st.sampled_from(["replace", "bilingual", "toc"]))
def test_write_back_twice_is_once(texts, mode):
    page = "".join(f"<p>t{k}</p>" for k in range(len(texts)))
    once = M.written_back(page, {k: t.strip() for k, t in enumerate(texts)}, mode)
    if mode == "bilingual":
        assert M.written_back(once, {k: t.strip() for k, t in enumerate(texts)}, mode) == once
    if mode == "replace":
        assert [t for _, _, t, *_ in M.leaf_blocks(once)] == [t.strip() for t in texts]


def test_svg():
    assert M.simplified_svg('<svg viewBox="0 0 3 4"><image xlink:href="a.jpg"/></svg>') == '<img src="a.jpg" alt="" width="3" height="4"/>'
    for kept in ('<svg><path/><image href="a"/></svg>', '<svg><image href="a"/><image href="b"/></svg>', "<svg></svg>"):
        assert M.simplified_svg(kept) == kept


def book(opf=None, container=True):
    opf = opf or """<package><manifest><item id='n' href='toc.ncx' media-type='application/x-dtbncx+xml'/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/><item id='a' href='../a.xhtml' media-type='application/xhtml+xml'/>
    <item id="z" href="t/z.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine toc="n"><itemref idref="b"/><itemref idref="a"/><itemref idref="b"/></spine></package>"""
    files = {"mimetype": b"application/epub+zip", "OEBPS/p.opf": opf.encode(), "OEBPS/t/b.xhtml": b"<p>B one</p><p>B two</p>", "a.xhtml": b"<p>A</p>", "OEBPS/t/z.xhtml": b"<p>Z</p>", "OEBPS/c.css": b"p{}",
             "OEBPS/toc.ncx": b"<ncx><navPoint><navLabel><text>Bee</text></navLabel><content src='t/b.xhtml#x'/></navPoint></ncx>"}
    if container:
        files["META-INF/container.xml"] = b"<container><rootfiles><rootfile full-path='OEBPS/p.opf'/></rootfiles></container>"
    return EP.packed(files)


def test_epub(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    books = EP.containers(spark, str(tmp_path))
    docs = EP.documents(books).orderBy("position").collect()
    assert [(r.position, r.file, r.title, r.page_type) for r in docs] == [(0, "OEBPS/t/b.xhtml", "Bee", "content"), (1, "a.xhtml", "Unknown Section", "content"), (2, "OEBPS/t/z.xhtml", "Unknown Section", "content")]
    assert EP.entries(books).count() == 8
    lines = FL.read_input(spark, str(tmp_path / "one.epub")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "B one"), (2, "B two"), (3, "A"), (4, "Z")]
    pages = spark.createDataFrame([(docs[0].path, "a.xhtml", "<p>new</p>"), (docs[0].path, "absent", "x")], "path string, file string, html string")
    out = {r.path: r.content for r in EP.rewritten(books, pages).collect()}[docs[0].path]
    with zipfile.ZipFile(io.BytesIO(bytes(out))) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("a.xhtml") == b"<p>new</p>" and len(z.namelist()) == 8
    with pytest.raises(ValueError):
        FL.read_input(spark, "x.pdf")


def test_epub_fallbacks():
    broken = book('<package><manifest><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml" properties="nav"><spine><itemref idref="b"></spine>', container=False)
    assert [d[1] for d in EP.book_documents(broken)] == ["OEBPS/t/b.xhtml"] and EP.book_documents(broken)[0][3] == "toc"
    assert EP.find_opf({"META-INF/container.xml": b"<broken full-path='x.opf'", "y.opf": b""}) == "x.opf" and EP.find_opf({}) is None
    assert EP.resolved("a/b", "../c/./d.html#f") == "a/c/d.html"


def test_spine_join(spark):
    spine = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b")], "k int, pos int, id string")
    manifest = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "z", "Z"), (1, "c", "C")], "k int, id string, href string")
    assert [r.id for r in EP.spine_order(spine, manifest, "k").orderBy("position").collect()] == ["b", "a", "c", "z"]


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" a \r\n\r\n　b\n", encoding="utf-8", newline="")
    blocks = FL.text_blocks(spark, str(tmp_path / "t.txt"))
    assert [(r["index"], r.src_text) for r in blocks.orderBy("index").collect()] == [(0, "a"), (1, "b")]
    done = blocks.withColumn("dst_text", F.when(F.col("index") == 0, "A"))
    assert [r.value for r in FL.output_lines(done, True).orderBy("index", "part").collect()] == ["a", "A", "", "b", "b", ""]
    FL.write_texts(done, str(tmp_path / "out"))
    assert "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "out" / "*")).collect()) == "A\nb\n"
    (tmp_path / "g.json").write_text(json.dumps([{"src": "a", "dst": "b", "info": ""}]))
    (tmp_path / "h.json").write_text(json.dumps([{"src": "a", "dst": "b", "info": ""}, {"src": "a"}]))
    assert FL.read_glossary(spark, str(tmp_path / "g.json")).count() == 1 and FL.read_glossary(spark, str(tmp_path / "h.json")).count() == 0
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "x_output.json").write_text(json.dumps([{"src": "q", "dst": "r", "info": ""}]))
    assert [r.src for r in FL.read_folder(spark, str(tmp_path / "books"), "_output.json", FL.GLOSSARY_SCHEMA).collect()] == ["q"]
    (tmp_path / "b.json").write_text(json.dumps([{"index": 1, "src_text": "s"}]))
    assert FL.read_blocks(spark, str(tmp_path / "b.json")).first().page_type == "content"
    (tmp_path / "r.json").write_text(json.dumps({"boundaries": {}, "categories": [{"id": "q"}]}))
    assert FL.load_rules(spark, str(tmp_path / "r.json")).categories[0].id == "q" and FL.load_rules(spark).categories and FL.load_rules(spark, None, False) is None
    assert FL.fingerprint(a=1) != FL.fingerprint(a=2) and len(FL.file_digests(spark, str(tmp_path / "t.txt")).first().sha256) == 64


def test_translation_with_retries_and_resume(spark):
    docs = spark.createDataFrame([(d, "\n".join(f"Line {k} of text number {d} goes on" for k in range(45))) for d in range(4)], "doc_id long, text string")
    upper = lambda: TR.P.Stub()
    s = TR.Settings(batch_size=10, workers=2, max_retry=1)
    out = TR.translate(docs, s, upper())
    rows = out.collect()
    assert len(rows) == 180 and all(r.dst == r.line.upper() for r in rows if r.dst is not None)
    by = {(r.bucket, r.attempts): r.n for r in TR.summary(out).collect()}
    assert by[("none", 1)] > 100 and by[("none", 2)] > 0 and sum(by.values()) == 180
    done = out.select("doc_id", "line_no", "line", "dst")
    calls = spark.sparkContext.accumulator(0)

    def counting(number, jsonl, attempt):
        calls.add(1)
        return jsonl.upper()

    again = TR.translate(docs, s, counting, done=done.filter("doc_id < 3 or line_no > 10")).collect()
    assert len(again) == 180 and calls.value == 1
    with pytest.raises(ValueError):
        TR.Settings(batch_size=0)


def test_batches_by_count(spark):
    rows = spark.createDataFrame([("a", k, f"x{k}") for k in range(19)], "key string, id long, item string")
    assert [(r.batch, len(r["items"])) for r in B.batches_by_count(rows).orderBy("batch").collect()] == [(0, 8), (1, 8), (2, 3)]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(src)
    listener = B.Progress()
    spark.streams.addListener(listener)
    stream = B.read_rate_limited(spark, src, "doc_id long, text string")
    for _ in range(2):  # the second run finds nothing new
        q = B.run_resumable(stream, str(tmp_path / "ck"), str(tmp_path / "out"), lambda b: b.select("doc_id", F.length("text").alias("n")))
        assert q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == docs.count() and out.select("batch").distinct().count() == 3
    spark.streams.removeListener(listener)


def test_event_time(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert B.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count() == B.sessions(events).agg(F.sum("n")).first()[0]


def test_count_or_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", f"x{k}") for k in range(10)], "key string, item string").coalesce(1).write.parquet(src)
    stream = B.read_rate_limited(spark, src, "key string, item string")
    q = B.micro_batches(stream, 4, 50).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.awaitTermination(30)  # processAllAvailable would wait on the timers
    finally:
        q.stop()
    got = sorted((r.batch, len(r["items"]), r.why) for r in spark.sql("select * from closed").collect())
    assert got[:2] == [(0, 4, "count"), (1, 4, "count")] and got[2:] in ([], [(2, 2, "time")])
