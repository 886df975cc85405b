"""URL filter: fixed host and path rules, and rules mined from labels.

A fixed rule fits a host and its subdomains if the path starts with the
rule's; the longest wins.  Other urls are judged by association rules: Spark's FP-growth mines
combinations of url tokens that imply a label.  A rule needs ``min_urls`` labelled urls that bear it
out, at every size of the table; a certainty factor, which is the share of the way from its label's base rate
to 1 that its confidence goes, so that rare and common labels reach it alike; and a lower confidence limit (Wilson's)
above that base rate.  Rules that a rule of one token less covers at no less
certainty go.  Each rule is indexed by the token that the fewest rules have; a url tries only the
rules of its own tokens, and the most certain one decides.

Up to ``RULES_SENT`` rules go to every task; more are joined by their index tokens.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; unlabelled or null-labelled urls do not train; where
one label is all there is nothing tells urls apart, so there are no rules; urls that no rule
fits are allowed; repeated rows are judged alike; other columns are ignored; empty pages give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import stored

# The rules as (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rules that may be sent to every task.
RULES_SENT = 20_000


@dataclass(frozen=True)
class MiningLimits:
    min_urls: int = 30
    min_certainty: float = 0.1
    #: Standard errors of the lower confidence limit.
    errors: float = 1.64


@dataclass(frozen=True)
class MinedRule:
    tokens: frozenset
    block: bool
    certainty: float
    urls: int


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def url_tokens(url: str | None) -> list[str]:
    """At most nine tokens, of nine kinds."""
    if not url or "://" not in url:
        return []
    m = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", url.split("://", 1)[1], re.S)
    host, path, query, fragment = m[1].lower(), m[2], m[3] or "", m[4]
    labels = host.split(".")
    parts = [re.sub(r"[0-9]+", "0", x) for x in path.split("/") if x]
    keys = sorted({x.split("=", 1)[0] for x in query[1:].split("&") if x})
    out = [f"host:{host}", f"top:{labels[-1]}", f"depth:{min(len(parts), 9)}"]
    if len(labels) > 1:
        out += [f"domain:{'.'.join(labels[-2:])}", f"label:{labels[0]}"]
    if parts:
        out.append(f"first:{parts[0]}")
        if "." in parts[-1]:
            out.append(f"ext:{parts[-1].rpartition('.')[2]}")
    if keys:
        out.append(f"keys:{'&'.join(keys)}")
    if fragment:
        out.append("fragment")
    return out


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[*url_tokens(u.as_py()), "=block" if b.as_py() else "=keep"] for u, b in zip(batch.column(0), batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["items"])


_RULES = "tokens array<string>, block boolean, certainty double, urls long"


def mine(labelled: DataFrame, limits: MiningLimits = MiningLimits()) -> DataFrame:
    """Pruned rules (sorted tokens, block, certainty, urls that bear it out) from labelled (url, block)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    items = stored(labelled.filter("block is not null").select(F.col("url").cast("string"), F.col("block").cast("boolean")).mapInArrow(K.releasing(_tokenise), "items array<string>"), "url-items")
    n, bad = items.agg(F.count("*"), F.count(F.when(F.array_contains("items", "=block"), 1))).first()
    if not 0 < bad < n:
        return spark.createDataFrame([], _RULES)
    base = {"=block": bad / n, "=keep": 1 - bad / n}
    least = min(b + limits.min_certainty * (1 - b) for b in base.values())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (limits.min_urls - 0.5) / n), minConfidence=least).fit(items)
    found = model.associationRules.withColumn("label", F.col("consequent")[0]).filter(F.col("label").isin(*base) & ~F.exists("antecedent", lambda t: t.startswith("=")))
    rate = F.when(F.col("label") == "=block", base["=block"]).otherwise(base["=keep"])
    found = found.withColumns({"urls": F.round(F.col("support") * n).cast("long"), "seen": F.round(F.col("support") * n / F.col("confidence")), "rate": rate})
    c, m, z = F.col("confidence"), F.col("seen"), limits.errors
    lower = (c + z * z / (2 * m) - z * F.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    certainty = (c - F.col("rate")) / (1 - F.col("rate"))
    good = found.filter((certainty >= limits.min_certainty) & (lower > F.col("rate")) & (F.col("urls") >= limits.min_urls))
    rules = stored(good.select(F.array_sort("antecedent").alias("tokens"), (F.col("label") == "=block").alias("block"), certainty.alias("certainty"), "urls"), "url-rules")
    shorter = rules.select("tokens", "block", "certainty", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    wider = rules.select(F.col("tokens").alias("part"), F.col("block").alias("same"), F.col("certainty").alias("known"))
    covered = shorter.join(wider, "part").filter("block = same and known >= certainty").select("tokens", "block").distinct()
    return stored(rules.join(covered, ["tokens", "block"], "left_anti").select("tokens", "block", "certainty", "urls"), "kept-url-rules")


def _rank(r: MinedRule):
    """The most certain rule first, then the one with the most urls."""
    return -r.certainty, -r.urls, sorted(r.tokens), r.block


def build_index(rules: Sequence[MinedRule]) -> dict[str, list[MinedRule]]:
    """Rules under the token that the fewest rules have, best first."""
    often: dict[str, int] = defaultdict(int)
    for r in rules:
        for t in r.tokens:
            often[t] += 1
    index: dict[str, list[MinedRule]] = defaultdict(list)
    for r in sorted(rules, key=_rank):
        index[min(r.tokens, key=lambda t: (often[t], t))].append(r)
    return dict(index)


def mined_verdict(url: str | None, index: dict[str, list[MinedRule]]) -> str:
    tokens = set(url_tokens(url))
    fit = [r for t in tokens for r in index.get(t, ()) if r.tokens <= tokens]
    best = min(fit, key=_rank, default=None)
    return "block" if best is not None and best.block else "allow"


def _judge(index: dict[str, list[MinedRule]]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, fixed = batch.column(batch.schema.get_field_index("url")), batch.column(batch.schema.get_field_index("verdict"))
            verdicts = [f.as_py() or mined_verdict(u.as_py(), index) for u, f in zip(urls, fixed)]
            names = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(verdicts, pa.string())], names=[*names, "verdict"])

    return judge


def _url_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(url_tokens(u.as_py())) for u in batch.column(0)], pa.list_(pa.string()))], names=["url", "own"])


def joined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(judged_url, mined) of each url of urls that a rule fits, by a join on the rules' index tokens."""
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    named = rules.select("*", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens", "block", "certainty", "urls").agg(F.min(F.struct("n", "token")).alias("least"))
    index = named.select("tokens", "block", "certainty", "urls", F.col("least.token").alias("token"))
    tried = urls.select("url").distinct().mapInArrow(K.releasing(_url_tokens), "url string, own array<string>").select("url", "own", F.explode("own").alias("token"))
    fit = tried.join(index, "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    best = fit.groupBy("url").agg(F.min(F.struct((-F.col("certainty")).alias("c"), (-F.col("urls")).alias("u"), "tokens", "block")).alias("rule"))
    return best.select(F.col("url").alias("judged_url"), F.when(F.col("rule.block"), "block").otherwise("allow").alias("mined"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limits: MiningLimits = MiningLimits(), rules_sent: int = RULES_SENT) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url)."""
    mined = mine(labelled, limits)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    if mined.count() > rules_sent:
        verdicts = joined_verdicts(rows.filter("verdict is null"), mined)
        return rows.join(verdicts, rows["url"] == F.col("judged_url"), "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"))
    known = [MinedRule(frozenset(r["tokens"]), r["block"], r["certainty"], r["urls"]) for r in mined.collect()]  # at most rules_sent
    return rows.mapInArrow(K.releasing(_judge(build_index(known))), "page_id long, host string, path string, rule string, verdict string")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls whose id has a label; low quality or toxic means block."""
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return pages.select("page_id", "url").join(bad, "page_id").select("url", "block")
