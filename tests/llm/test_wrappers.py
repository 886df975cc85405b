import html
import re

from linewright.llm import html_blocks, queries, wrappers

from ..conftest import SF


def plain(page):
    """The article of a test page, by its own shape: one article element with headings and unnested paragraphs."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", body)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in parts]
    return "\n\n".join(x for x in texts if x)


def test_whole_table(spark):
    sf = SF.replace("0.001", "0.01")
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op3_host_wrappers(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_what_is_not_the_article_goes():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div><main><article><header>by x</header>
    <h2>T &amp; u</h2><p>a<b>b</b>  c<br>d<ul><li>one<li>two</ul><aside>no</aside><form>f <input> g</form><script>var t="</p>";</script>
    <table><tr><td>x<td>y</table><section class="comments"><p>first!</p></section><p>end <span class="ad">buy</span> now</article></main><footer>f"""
    assert text_of(page) == "T & u\n\nab c d\n\none\n\ntwo\n\nx\n\ny\n\nend now"


def text_of(page, shape=None):
    blocks, tree = html_blocks.read(page)
    return wrappers.main_text(blocks, tree, *wrappers._Hosts().get(shape))


def shape_of(pages):
    """The wrapper that one batch of pages makes."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * len(pages)), pa.array(pages)], names=["host", "html"])
    return next(wrappers._shapes([batch])).column(1)[0].as_py()


def expression(*pages):
    import json

    return wrappers.as_text(json.loads(shape_of(list(pages)))[0])


def test_expressions():
    ul = lambda n, more="": "<ul>" + "".join(f"<li>{k}</li>" for k in range(n)) + "</ul>" + more
    # One page is its own tokens; runs of different length repeat, what only some pages have is optional.
    assert expression(ul(2)) == "<ul><li>#</li><li>#</li></ul>"
    assert expression(ul(3), ul(5, "<p>x</p>"), ul(1)) == "<ul>(<li>#</li>)+</ul>(<p>#</p>)?"
    # Equal runs keep their places.
    assert expression("<div>a</div><div>b</div><div><p>c</p></div>", "<div>d</div><div>e</div><div><p>f</p><p>g</p></div>") == "<div>#</div><div>#</div><div>(<p>#</p>)+</div>"
    # Parts that come back in varying numbers span a group.
    assert expression("<h2>a</h2><p>b</p>", "<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>") == "((<h2>#</h2>)*(<p>#</p>)*)+"
    assert expression("<p>x</p>", "") == "(<p>#</p>)?"
    # More kinds of elements than a level may have.
    wide = "".join(f"<x-{chr(97 + k // 26)}{chr(97 + k % 26)}>t{k}</x-{chr(97 + k // 26)}{chr(97 + k % 26)}>" for k in range(300))
    assert expression(wide) == "((<*>(#)+</*>)*)+" or expression(wide).count("#") == 1
    many = "".join(f"<div class='c{chr(97 + k // 26)}{chr(97 + k % 26)}'>t{k}</div>" for k in range(300))
    assert expression(many).count("#") == 1 and "div" in expression(many)


def unnamed(k, head="Site of all things", lead=True):
    """A page without article, roles or telling classes."""
    body = "".join(f"<div>para {k}.{j} with words of its own that go on {k * j}</div>" for j in range(2 + k % 4))
    return f"<body><div>{head}</div><div><a href=/>All</a> <a href=/{k}>More {k}</a></div><section><h2>Title {k}</h2>{'<div>Subscribe to get it all</div>' if lead else ''}<section>{body}</section><div>Last words of {k} and what follows from them</div></section><div>Contact us by any means</div></body>"


def wanted(k):
    return "\n\n".join([f"Title {k}", *(f"para {k}.{j} with words of its own that go on {k * j}" for j in range(2 + k % 4)), f"Last words of {k} and what follows from them"])


def test_pages_without_telling_names():
    pages = [unnamed(k) for k in range(12)]
    shape = shape_of(pages)
    # Template text and links go, wherever they stand; all parts of the article stay.
    assert [text_of(p, shape) for p in pages] == [wanted(k) for k in range(12)]
    assert text_of(unnamed(99), shape) == wanted(99)
    # Without the wrapper, or with that of other pages, the same page is not told apart.
    other = shape_of([f"<table><tr><td>{k}</td></tr></table>" for k in range(12)])
    for wrong in (None, other):
        assert "Site of all things" in text_of(pages[0], wrong) and "Subscribe" in text_of(pages[0], wrong)
    # Any order of merging finds the same.
    import json

    import pandas as pd

    parts = [shape_of(pages[k::4]) for k in range(4)]
    merged = wrappers._merge_shapes(pd.DataFrame({"host": "h", "shape": parts}))["shape"][0]
    assert json.loads(merged)[1] == json.loads(shape)[1] and [text_of(p, merged) for p in pages] == [wanted(k) for k in range(12)]


def test_constant_notice_inside_the_article():
    pages = [f"<article><h1>Title {k}</h1><p>Terms of this site apply to you</p>" + "".join(f"<p>own {k} {j}</p>" for j in range(3)) + "</article>" for k in range(8)]
    assert text_of(pages[3], shape_of(pages)) == "Title 3\n\nown 3 0\n\nown 3 1\n\nown 3 2"
    # Too few different pages say nothing, however often they occur.
    assert "Terms" in text_of(pages[3], shape_of(pages[:3] * 20))


def test_large_pages_take_seconds():
    import time

    flat = "".join(f"<p>paragraph {k}</p>" for k in range(50_000))
    kinds = "".join(f"<div class='k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>t{k}</div>" for k in range(17_000))
    deep = "".join(f"<div>level {k}" for k in range(20_000))
    mixed = "".join(f"<h2>h{k}</h2>" + "<p>x</p>" * (k % 5) + "<ul><li>a</ul>" * (k % 3) for k in range(10_000)) + "</b></i>" * 20_000
    began = time.time()
    for page in (flat, kinds, deep, mixed):
        shape = shape_of([page, page + "<p>end</p>", "<p>one</p>"])
        assert len(shape) < 100_000
        blocks, _ = html_blocks.read(page)
        whole = "\n\n".join(b.text for b in blocks)
        # Of ever deeper elements the outer ones with next to no text are not the article.
        assert whole.endswith(text_of(page, shape)) and len(text_of(page, shape)) >= (0.95 if page is deep else 1) * len(whole)
    assert time.time() - began < 60


def test_hosts_by_join(spark):
    rows = [(k, f"http://{'a' if k % 3 else 'b'}.example/{k}", unnamed(k)) for k in range(24)] + [(0, None, unnamed(1)), (None, "http://a.example/1", unnamed(1))] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for sent in (0, wrappers.BROADCAST_CHARS):
        got = wrappers.extract_main_text(df, sent).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got if r.url and r.page_id} == {k: wanted(k) for k in range(1, 24)}
        assert {r.text for r in got if r.page_id is None} == {wanted(1)}


def test_edges(spark):
    page = "<article><p>One &lt;two&gt;</p></article>"
    odd = [None, "", "   ", "no tags &amp; text", "<", "<p", "<a title='x>y", "<!-- open", page, page, "<div>" * 3000 + "deep", "<p>" * 2000, "x" * 200_000, "<script>never ends", "</p></div>", "<p>a\x00b</p>"]
    rows = [(i, None if i == 1 else "http://h.example/" if i % 2 else "nonsense", h, "x") for i, h in enumerate(odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrappers.extract_main_text(df).collect()}
    assert len(got) == len(odd) and got[0] == got[1] == got[2] == "" and got[8] == got[9] == "One <two>" and got[3] == "no tags & text" and got[12] == "x" * 200_000
    assert wrappers.extract_main_text(df.limit(0)).count() == 0
