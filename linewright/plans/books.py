"""Queries that send tables through books, markup, vocabularies and responses and back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import script
from ..functions import text as T
from ..operators import entities as E
from ..operators import glossary as G
from ..operators import lines as L
from ..operators import markup as M
from ..operators import prompts as P
from ..operators import quality as Q
from ..sources import epub as EP
from . import oracle as O
from . import translation as TR

PAGES_A_BOOK = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(pages: DataFrame) -> DataFrame:
    """path and content: books of pages (book, id, html), the last page first, with titles for the even ones in a table of contents inside folders."""

    @F.udf("binary", useArrow=True)
    def bind(pages):
        order = sorted(((p["id"], p["html"]) for p in pages), reverse=True)
        items = "".join(f'<item id="i{i}" href="text/../text/p{i}.xhtml#top" media-type="application/xhtml+xml"/>' for i, _ in order)
        opf = f'<package><manifest>{items}<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n">{"".join(f"<itemref idref={chr(34)}i{i}{chr(34)}/>" for i, _ in order)}</spine></package>'
        points = "".join(f'<navPoint><navLabel><text>Title {i}</text></navLabel><content src="text/p{i}.xhtml#a"/></navPoint>' for i, _ in order if i % 2 == 0)
        files = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfile full-path="OEBPS/book.opf"/></container>', "OEBPS/book.opf": opf, "OEBPS/toc.ncx": f"<ncx><navMap>{points}</navMap></ncx>"}
        return EP.packed({k: v.encode() for k, v in {**files, **{f"OEBPS/text/p{i}.xhtml": page or "" for i, page in order}}.items()})

    per = pages.groupBy("book").agg(F.collect_list(F.struct("id", "html")).alias("pages"))
    return per.select(F.concat(F.lit("book"), F.col("book").cast("string"), F.lit(".epub")).alias("path"), bind("pages").alias("content"))


def _page_books(spark, sf_dir):
    return _bound(_table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES_A_BOOK).alias("book"), F.col("page_id").alias("id"), "html"))


def book_documents(spark, sf_dir):
    """Pages bound into containers and read back: order, file, title, kind and markup."""
    docs = EP.documents(_page_books(spark, sf_dir))
    return docs.select("path", F.col("position").cast("long").alias("position"), "file", "title", "page_type", F.md5("html").alias("html"))


def _xhtml(lines: DataFrame) -> DataFrame:
    """doc_id and html: the lines as paragraphs, every third a heading, every fifth with ruby, inside a section and a list."""
    n, escaped = F.col("line_no"), T.html_escaped(F.col("line"))
    ruby = F.when(n % 5 == 0, F.concat(F.lit("<ruby>x<rp>(</rp><rt>note</rt><rp>)</rp></ruby>"), escaped)).otherwise(escaped)
    block = F.when(n % 3 == 0, F.concat(F.lit("<h2 id='a'> "), ruby, F.lit("</h2>"))).when(n % 7 == 0, F.concat(F.lit("<ul><li>"), ruby, F.lit("</ul>"))).otherwise(F.concat(F.lit('<p class="k">'), ruby, F.lit("</p>")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, block.alias("b")))), lambda s: s["b"]), "")
    return lines.groupBy("doc_id").agg(F.concat(F.lit("<html><body><section>"), joined, F.lit("</section><p> </p><script>var t='<p>no</p>';</script></body></html>")).alias("html"))


def _lines(spark, sf_dir):
    return L.scan_lines(_table(spark, sf_dir, "documents"))


def book_blocks(spark, sf_dir):
    """Leaf blocks of markup: index, tag and text without ruby."""
    found = M.html_blocks(_xhtml(_lines(spark, sf_dir)), "doc_id")
    return found.select("doc_id", F.col("index").cast("long").alias("index"), "tag", F.md5("text").alias("text"))


def _said(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.filter("line_no % 2 = 0").select("doc_id", (F.col("line_no") - 1).cast("int").alias("index"), F.concat(F.lit("<"), F.md5("line"), F.lit(">")).alias("dst"))


def book_write_back(spark, sf_dir):
    """Translations of the even blocks in place of the text, and as marked copies beside it, written twice."""
    pages, said = _xhtml(_lines(spark, sf_dir)), _said(spark, sf_dir)
    replaced = M.write_back(pages, said, "doc_id", "replace").select("doc_id", F.md5("html").alias("replaced"))
    once = M.write_back(pages, said, "doc_id", "bilingual", "1em")
    twice = M.write_back(once, said, "doc_id", "bilingual", "1em").select("doc_id", F.md5("html").alias("bilingual"))
    return replaced.join(twice, "doc_id")


def book_export(spark, sf_dir):
    """Saved translations put into containers without a model; the text of the books afterwards."""
    pages = _xhtml(_lines(spark, sf_dir)).select(F.floor(F.col("doc_id") / PAGES_A_BOOK).alias("book"), F.col("doc_id").alias("id"), "html")
    books = TR.kept(_bound(pages))
    docs = EP.documents(books)
    lines = TR.book_lines(docs)
    saved = lines.select("path", "line_no", F.when(F.col("line_no") % 2 == 0, F.md5("line")).alias("dst"))
    out = TR.book_lines(EP.documents(TR.export_books(books, docs, lines, saved)))
    return out.select("path", "line_no", "file", F.md5("line").alias("line"))


def context_items(spark, sf_dir):
    """The ten best mentions of each name, cut to 220 characters: what a model is told of a name."""
    rows = L.scan_lines(_table(spark, sf_dir, "documents").select("doc_id", script.projected(F.col("text")).alias("text")))
    found = E.character_mentions(rows, E.gazetteer(rows))
    return G.context_items(found, ["doc_id"]).select("doc_id", "name", F.col("rank").cast("long").alias("rank"), "line_no", F.md5("text").alias("text"))


VOCABULARY = {ch: k for k, ch in enumerate("[etaoin shrdluETAOIN")}


def vocabulary_ids(spark, sf_dir):
    """Places and ids of the characters that a vocabulary knows, with room for both ends."""
    known = F.create_map(*(F.lit(x) for kv in VOCABULARY.items() for x in kv))
    ids = E.encode_characters(F.col("line"), known)
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.size(ids).alias("n"), F.md5(F.array_join(F.transform(ids, lambda s: F.concat_ws(":", s["pos"], s["id"])), ",")).alias("ids"))


def stage_counts(spark, sf_dir):
    """Lines that are translated, failed or pending."""
    lines = _lines(spark, sf_dir).withColumn("dst", F.when(F.col("line_no") % 3 == 0, F.col("line")).when(F.col("line_no") % 3 == 1, F.lit(" ")))
    return Q.stage_summary(lines, lines.filter("line_no % 5 = 0").select("doc_id", "line_no"), ["doc_id", "line_no"])


def response_diagnostics(spark, sf_dir):
    """Answers with indexes that are missing, twice, out of range or unreadable, and what is said of them."""
    rows = _lines(spark, sf_dir).filter("line_no <= 4").select("doc_id", "line_no", F.md5("line").alias("m"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "m"))).alias("s"))
    one = lambda k, value: F.concat(F.lit('{"'), F.lit(str(k)), F.lit('":"'), value, F.lit('"}'))
    m = F.get("s", F.lit(0))["m"]
    said = F.concat_ws("\n", F.lit("<think>no</think>"), one(1, F.lit("first")), F.lit("not read"), one(1, m), F.concat(F.lit("{'3':'"), m, F.lit("'}")), one(9, m), F.lit('{"4": 7}'), F.lit('{"x":"y"}'))
    parsed = P.parse_responses(per.select("doc_id", said.alias("response"), F.lit(4).cast("long").alias("expected")), ["doc_id"])
    text = P.diagnostic_summary(F.col("missing"), F.col("duplicate"), F.col("out_of_range"), F.col("malformed"))
    return parsed.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_keys("translations")), lambda k: F.concat_ws("=", k, F.element_at("translations", k))), ",").alias("translations"), text.alias("summary"))


class NameModel:
    """A stand-in that translates names by their length and says a gender by their first letter; every fifth is no name, some answers need another try."""

    def __call__(self, name: str, context: str, attempt: int) -> str:
        base = ("林", "王", "李", "張")[len(name) % 4] if attempt > 1 or len(name) % 3 else "カ"
        sex = "女性" if name[0] in "AEIOU" else "男性" if name[0] in "TS" else ""
        return f'So: {{"is_name": {str(ord(name[0]) % 5 != 0).lower()}, "translated_chinese_name": "{base}", "gender": "{sex}", "full_name": "{name[:3]}"}}'


def glossary_build(spark, sf_dir):
    """From mentions to glossary rows: clusters, contexts, a model's bases with its second tries, aliases, genders by evidence and by propagation."""
    rows = L.scan_lines(_table(spark, sf_dir, "documents").select("doc_id", script.projected(F.col("text")).alias("text")))
    found = E.character_mentions(rows, E.gazetteer(rows))
    named = found.withColumn("name", F.concat(F.left("name", F.lit(5)), F.when(F.length("name") % 4 == 0, "君").when(F.length("name") % 4 == 1, "姉さん").otherwise("")))
    return G.glossary_from(named, ["doc_id"], NameModel()).select("doc_id", "src", "dst", "info", "key", F.col("alias_rank").cast("long").alias("alias_rank"))


def spine_order(spark, sf_dir):
    """The reading order as a join: the spine without repetitions, then what else the manifest has."""
    pages = _table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("book"), F.col("page_id").cast("string").alias("id"), F.md5("url").alias("href"), (F.col("page_id") * 7 % 50).alias("pos"))
    spine = pages.filter("cast(id as bigint) % 3 <> 0").select("book", "pos", "id")
    twice = spine.unionByName(spine.withColumn("pos", F.col("pos") + 100))
    return EP.spine_order(twice, pages.select("book", "id", "href"), "book").select("book", "id", "href", F.col("position").cast("long").alias("position"))


def entry_lookup(spark, sf_dir):
    """Wanted names among the entries of books: exact paths, ends of paths, last parts."""
    pages = _table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("book"), (F.col("page_id") % 4).cast("string").alias("a"), (F.col("page_id") % 7).cast("string").alias("b"))
    j = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    listing = pages.select("book", j("OEBPS/d", F.col("a"), "/p", F.col("b"), ".xhtml").alias("entry")).distinct()
    wanted = F.array(j("OEBPS/d", F.col("a"), "/p", F.col("b"), ".xhtml"), j("d", F.col("a"), "/p", F.col("b"), ".xhtml"), j("p", F.col("b"), ".xhtml"), j("other/p", F.col("b"), ".xhtml"), F.lit("none.xhtml"))
    return EP.find_entries(pages.select("book", F.explode(wanted).alias("name")).distinct(), listing, "book")


def name_quality(spark, sf_dir):
    """Counters of the names of the glossary's sources."""
    from . import catalog

    chars = catalog.glossary_entries(spark, sf_dir).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("count"))
    return G.name_quality(chars)


def counted_batches(spark, sf_dir):
    """Events of a type in batches of at most eight, in order."""
    from ..streaming import batcher as B

    events = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("item"))
    return B.batches_by_count(events).select("key", "batch", F.md5(F.array_join("items", ",")).alias("items"))


def event_windows(spark, sf_dir):
    """Events by type and window of five minutes."""
    from ..streaming import batcher as B

    found = B.windowed_counts(_table(spark, sf_dir, "events"))
    return found.select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def event_sessions(spark, sf_dir):
    """Sessions of users: events with gaps under ten minutes."""
    from ..streaming import batcher as B

    found = B.sessions(_table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start"), "n")


QUERIES = {f.__name__: f for f in (spine_order, entry_lookup, name_quality, counted_batches, event_windows, event_sessions, book_documents, book_blocks, book_write_back, book_export, context_items, vocabulary_ids, stage_counts, response_diagnostics, glossary_build)}

_TRIM = O.trim
_PLAIN = rf"""split AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> '') AS p FROM documents),
scanned AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM split)"""
_ESCAPED = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RUBY = f"CASE WHEN line_no % 5 = 0 THEN '<ruby>x<rp>(</rp><rt>note</rt><rp>)</rp></ruby>' ELSE '' END || {_ESCAPED}"
_MARK = "'&lt;' || md5(line) || '&gt;'"


def _page(inner: str, after: str = "''") -> str:
    """The page of _xhtml with other contents of its blocks, and something after each."""
    block = f"CASE WHEN line_no % 3 = 0 THEN '<h2 id=''a''> ' || {inner} || '</h2>' || {after} WHEN line_no % 7 = 0 THEN '<ul><li>' || {inner} || {after} || '</ul>' ELSE '<p class=\"k\">' || {inner} || '</p>' || {after} END"
    return f"SELECT doc_id, md5('<html><body><section>' || string_agg({block}, '' ORDER BY line_no) || '</section><p> </p><script>var t=''<p>no</p>'';</script></body></html>') AS h FROM scanned GROUP BY doc_id"


_even = lambda a, b: f"CASE WHEN line_no % 2 = 0 THEN {a} ELSE {b} END"
_tag = "CASE WHEN line_no % 3 = 0 THEN 'h2' WHEN line_no % 7 = 0 THEN 'li' ELSE 'p' END"
_copy = f"'<' || {_tag} || ' class=\"{M.MARKER}\" style=\"margin-top:1em\">' || {_MARK} || '</' || {_tag} || '>'"
_vocabulary = "map {" + ", ".join(f"{O.q(k)}: {v}" for k, v in VOCABULARY.items()) + "}"

_weighed = f"{O.weights('t', N.MENTION_CUES)} + CASE WHEN regexp_matches(t, '[「『]') THEN 4 ELSE 0 END + CASE WHEN contains(t, 'こと') THEN 2 ELSE 0 END + floor((1000 - least(line_no, 1000)) / 100)"
_bases = "['林', '王', '李', '張'][1 + length(\"primary\") % 4]"

_name_key = O.strip_suffixes(f"(SELECT name, n, {O.trim("replace(name, '　', '')")} AS raw, CASE WHEN starts_with(raw, 'お') AND length(raw) > 2 THEN substr(raw, 2) WHEN starts_with(raw, 'ご') AND length(raw) > 2 THEN substr(raw, 2) ELSE raw END AS key FROM named)", "key", N.SUFFIXES)

ORACLE_SQL = {
    "spine_order": "WITH p AS (SELECT CAST(floor(page_id / 50) AS BIGINT) AS book, CAST(page_id AS VARCHAR) AS id, md5(url) AS href, CASE WHEN page_id % 3 <> 0 THEN page_id * 7 % 50 ELSE 1 << 30 END AS pos FROM pages) SELECT book, id, href, row_number() OVER (PARTITION BY book ORDER BY pos, id) - 1 AS position FROM p",
    "entry_lookup": """WITH p AS (SELECT CAST(floor(page_id / 50) AS BIGINT) AS book, CAST(page_id % 4 AS VARCHAR) AS a, CAST(page_id % 7 AS VARCHAR) AS b FROM pages), l AS (SELECT DISTINCT book, 'OEBPS/d' || a || '/p' || b || '.xhtml' AS entry FROM p),
      w AS (SELECT DISTINCT book, unnest(['OEBPS/d' || a || '/p' || b || '.xhtml', 'd' || a || '/p' || b || '.xhtml', 'p' || b || '.xhtml', 'other/p' || b || '.xhtml', 'none.xhtml']) AS name FROM p),
      m AS (SELECT w.book, name, entry, CASE WHEN entry = name THEN 0 WHEN ends_with(entry, '/' || name) THEN 1 ELSE 2 END AS r FROM w JOIN l ON l.book = w.book AND string_split(entry, '/')[-1] = string_split(name, '/')[-1])
      SELECT book, name, arg_min(entry, (r, entry)) AS entry FROM m GROUP BY ALL""",
    "name_quality": f"""WITH {O.ENTRIES_FROM}, named AS (SELECT src AS name, count(*) AS n FROM entries GROUP BY src), k AS (SELECT * FROM {_name_key}), m AS (SELECT count(*) AS c FROM (SELECT {O.trim('key')} AS z FROM k GROUP BY z HAVING count(DISTINCT name) > 1))
      SELECT count(*) AS names, CAST(sum(n) AS BIGINT) AS mentions, count_if(raw = '' OR raw IN ({O.TITLES}) OR {O.trim('key')} = '' OR {O.trim('key')} IN ({O.TITLES})) AS titles, count_if(length(raw) >= 2 AND ends_with(raw, '家')) AS families, count_if(regexp_matches(name, '[ 　]')) AS spaced, any_value(c) AS multi_alias FROM k, m""",
    "counted_batches": "WITH n AS (SELECT event_type AS key, event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 8) AS BIGINT) AS batch FROM events) SELECT key, batch, md5(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id)) AS items FROM n GROUP BY ALL",
    "event_windows": "SELECT epoch_us(ts) - epoch_us(ts) % 300000000 AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "event_sessions": "WITH l AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR t >= p + 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "context_items": f"""WITH {O.mentions("word")}, s AS (SELECT doc_id, line_no, name, t, row_number() OVER (PARTITION BY doc_id, name ORDER BY {_weighed} DESC, line_no, t) AS rank FROM said) SELECT doc_id, name, rank, line_no, md5(left(t, 220)) AS text FROM s WHERE rank <= 10""",
    # A first answer with kana is asked for again.
    "glossary_build": f"""WITH {O.mentions(O.SUFFIXED)}, {O.CLUSTERED}, c AS (SELECT *, max(count) OVER k AS cluster_max, sum(CASE WHEN name = "primary" THEN male + hm END) OVER k AS lm, sum(CASE WHEN name = "primary" THEN female + hf END) OVER k AS lf,
        bool_or(name = "primary" AND hinted) OVER k AS lead_hinted FROM clustered WINDOW k AS (PARTITION BY doc_id, key, part)),
      g AS (SELECT *, {_bases} AS base, CASE WHEN "primary"[1] IN ('A', 'E', 'I', 'O', 'U') THEN '{N.FEMALE}' WHEN "primary"[1] IN ('T', 'S') THEN '{N.MALE}' END AS asked, left("primary", 3) AS full_name FROM c
        WHERE ord("primary"[1]) % 5 <> 0 AND key NOT IN ({O.TITLES}) AND NOT (length(key) >= 2 AND ends_with(key, '家'))),
      e AS (SELECT *, CASE WHEN asked = '{N.MALE}' AND lm >= CASE WHEN lead_hinted THEN 4 ELSE 6 END AND lm >= lf + CASE WHEN lead_hinted THEN 2 ELSE 3 END THEN asked WHEN asked = '{N.FEMALE}' AND lf >= CASE WHEN lead_hinted THEN 4 ELSE 6 END AND lf >= lm + CASE WHEN lead_hinted THEN 2 ELSE 3 END THEN asked END AS sex,
        CASE WHEN starts_with(name, key) AND name <> key THEN base || CASE WHEN substr(name, length(key) + 1) = '君' THEN '君' ELSE '' END ELSE base END AS dst FROM g),
      i AS (SELECT *, CASE WHEN full_name <> key AND sex IS NOT NULL THEN full_name || ',' || sex WHEN sex IS NOT NULL THEN sex WHEN full_name <> key THEN full_name ELSE '' END AS own FROM e),
      f AS (SELECT doc_id, key, arg_min(sex, alias_rank) AS first_sex FROM i WHERE sex IS NOT NULL GROUP BY ALL)
      SELECT i.doc_id, name AS src, dst, CASE WHEN sex IS NULL AND first_sex IS NOT NULL THEN CASE WHEN own = '' THEN first_sex ELSE own || ',' || first_sex END ELSE own END AS info, i.key, alias_rank FROM i LEFT JOIN f ON i.doc_id = f.doc_id AND i.key = f.key""",
    "book_documents": rf"""WITH p AS (SELECT *, CAST(floor(page_id / {PAGES_A_BOOK}) AS BIGINT) AS book, len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS links, len(regexp_extract_all(html, '(?i)<(?:p|li|div)[\s>]')) AS blocks FROM pages)
      SELECT 'book' || book || '.epub' AS path, row_number() OVER (PARTITION BY book ORDER BY page_id DESC) - 1 AS position, 'OEBPS/text/p' || page_id || '.xhtml' AS file, CASE WHEN page_id % 2 = 0 THEN 'Title ' || page_id WHEN book_even THEN 'Unknown Section' ELSE 'i' || page_id END AS title,
      CASE WHEN links >= 3 AND 2 * links >= blocks THEN 'toc' ELSE 'content' END AS page_type, md5(html) AS html FROM (SELECT *, bool_or(page_id % 2 = 0) OVER (PARTITION BY book) AS book_even FROM p)""",
    "book_blocks": f"WITH {_PLAIN} SELECT doc_id, line_no - 1 AS index, {_tag} AS tag, md5(CASE WHEN line_no % 5 = 0 THEN 'x' || line ELSE line END) AS text FROM scanned",
    "book_write_back": f"WITH {_PLAIN}, r AS ({_page(_even(_MARK, _RUBY))}), b AS ({_page(_RUBY, _even(_copy, chr(39) * 2))}) SELECT doc_id, r.h AS replaced, b.h AS bilingual FROM r JOIN b USING (doc_id)",
    "book_export": f"""WITH {_PLAIN}, n AS (SELECT *, CAST(floor(doc_id / {PAGES_A_BOOK}) AS BIGINT) AS book, row_number() OVER (PARTITION BY CAST(floor(doc_id / {PAGES_A_BOOK}) AS BIGINT) ORDER BY doc_id DESC, line_no) AS place, CASE WHEN line_no % 5 = 0 THEN 'x' || line ELSE line END AS t FROM scanned)
      SELECT 'book' || book || '.epub' AS path, place AS line_no, 'OEBPS/text/p' || doc_id || '.xhtml' AS file, md5(CASE WHEN place % 2 = 0 THEN md5(t) ELSE t END) AS line FROM n""",
    "vocabulary_ids": f"""WITH {_PLAIN}, v AS (SELECT {_vocabulary} AS m), i AS (SELECT doc_id, line_no, list_filter(list_transform(range(1, length(line) + 1), lambda k: CASE WHEN map_contains(m, substr(line, k, 1)) THEN (k - 1) || ':' || m[substr(line, k, 1)] END), lambda x: x IS NOT NULL)[:510] AS ids FROM scanned, v)
      SELECT doc_id, line_no, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS ids FROM i""",
    "stage_counts": f"WITH {_PLAIN} SELECT CASE WHEN line_no % 3 = 0 THEN 'translated' WHEN line_no % 5 = 0 THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM scanned GROUP BY 1",
    "response_diagnostics": f"WITH {_PLAIN} SELECT doc_id, '1=' || md5(line) || ',3=' || md5(line) || ',4=7' AS translations, 'missing=2; duplicate=1; out_of_range=9; malformed=2' AS summary FROM scanned WHERE line_no = 1",
}
