"""Text and JSON in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators.rules import SMALL_PACK, RulePack
from . import epub

BLOCK_SCHEMA = "file_id string, file_name string, title string, `index` bigint, src_text string, dst_text string, page_type string"
GLOSSARY_SCHEMA = "src string, dst string, info string"
CHARACTER_SCHEMA = "name string, count bigint"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no and line of lines that are not blank."""
    return L.scan_lines(read_texts(spark, path), key="path")


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The same as blocks numbered from 0, not yet translated."""
    return text_lines(spark, path).select("path", (F.col("line_no") - 1).alias("index"), F.col("line").alias("src_text"), F.lit(None).cast("string").alias("dst_text"))


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no and line of a .txt or .epub; any other name is an error."""
    from ..operators import markup

    kind = path.rstrip("/").lower().rpartition(".")[2]
    if kind == "txt":
        return text_lines(spark, path)
    if kind == "epub":
        docs = epub.documents(epub.containers(spark, path))
        found = markup.html_blocks(docs.withColumn("_d", F.struct("path", "position")), "_d")
        one = found.groupBy("_d.path").agg(F.array_sort(F.collect_list(F.struct("_d.position", "index", "text"))).alias("b"))
        return one.select("path", F.posexplode("b").alias("p", "b")).select("path", (F.col("p") + 1).cast("long").alias("line_no"), F.col("b.text").alias("line"))
    raise ValueError(f"neither .txt nor .epub: {path}")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Saved translations; a missing page_type is content."""
    return spark.read.schema(BLOCK_SCHEMA).json(path, multiLine=True).withColumn("page_type", F.coalesce("page_type", F.lit("content")))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries (position, src, dst, info); if any lacks a field, the whole glossary is empty."""
    rows = spark.read.schema(GLOSSARY_SCHEMA).json(path, multiLine=True).select(F.monotonically_increasing_id().alias("position"), "src", "dst", "info")
    bad = rows.filter("src is null or dst is null or info is null").isEmpty()
    return rows if bad else rows.limit(0)


def read_folder(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    """JSON files of a folder by the end of their names, with the file of each row."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(path).withColumn("file", F.col("_metadata.file_path"))


def load_rules(spark: SparkSession, path: str | None = None, use_default: bool = True) -> RulePack | None:
    """The pack of an explicit file, else the built-in one, else none."""
    if path:
        return RulePack.parse(spark.read.text(path, wholetext=True).first()["value"])
    return SMALL_PACK if use_default else None


def output_lines(blocks: DataFrame, bilingual: bool = False) -> DataFrame:
    """path, order, value: translations, or source, translation and a blank line; where a translation is missing the source stands in, a blank one stays."""
    dst = F.coalesce("dst_text", "src_text")
    values = F.array(F.col("src_text"), dst, F.lit("")) if bilingual else F.array(dst)
    return blocks.select("path", "index", F.posexplode(values).alias("part", "value"))


def write_texts(blocks: DataFrame, out: str, bilingual: bool = False) -> None:
    """One ordered text per source file, in a folder that its whole path names: files of one name in two folders stay apart."""
    name = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", ""), "^/+|/+$", "")
    rows = output_lines(blocks, bilingual).withColumn("name", name)
    rows.repartition("name").sortWithinPartitions("name", "index", "part").select("name", "value").write.partitionBy("name").text(out)


def write_binaries(files: DataFrame, out: str, workers: int = 16) -> None:
    """files (path, content) under out, each by the last two parts of its path; a file is written whole to a name beside it and then renamed."""
    from urllib.parse import unquote, urlsplit

    if urlsplit(out).scheme not in ("", "file"):
        raise ValueError("binaries are written to a folder that all executors mount")
    root = unquote(urlsplit(out).path)

    def write(rows):
        import os
        import posixpath
        import uuid

        for r in rows:
            parts = unquote(urlsplit(r["path"]).path).strip("/").split("/")[-2:]
            target = posixpath.join(root, *parts)
            os.makedirs(posixpath.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(part, target)

    files.select("path", "content").repartition(workers, "path").foreachPartition(write)


def manifest(path: str, stage: str, **fields) -> dict:
    """What a work folder says of itself: fixed fields first, then what the caller adds; ``fingerprint`` covers all that must be equal to take it up again."""
    import datetime

    known = {
        "version": 1, "input": path, "stage": stage, "created": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"),
        **{k: fields.pop(k, None) for k in ("input_sha256", "source_lang", "target_lang", "model", "rules_sha256", "glossary_sha256", "batch_size", "context_lines", "max_retry", "similarity", "mode")},
    }
    changing = ("created", "stage")
    return {**known, **fields, "fingerprint": fingerprint(**{k: v for k, v in {**known, **fields}.items() if k not in changing})}


def write_snapshot(rows: DataFrame, folder: str, stage: str, about: dict) -> None:
    """A stage's rows and its manifest under folder/stage; the manifest comes last, so a folder without one is not whole."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(f"{folder}/{stage}/rows")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{stage}/manifest")


def read_snapshot(spark: SparkSession, folder: str, stage: str, schema: str, expected: str | None = None) -> DataFrame | None:
    """The rows of a whole stage whose fingerprint is the expected one (any, if none is given); else nothing."""
    from pyspark.errors import AnalysisException

    try:
        about = json.loads(spark.read.text(f"{folder}/{stage}/manifest").first()["value"])
        if expected is not None and about.get("fingerprint") != expected:
            return None
        return spark.read.schema(schema).json(f"{folder}/{stage}/rows")
    except (AnalysisException, TypeError, ValueError):
        return None


def write_json(rows: DataFrame, out: str) -> None:
    rows.write.mode("overwrite").json(out)


def fingerprint(**fields) -> str:
    """What must be equal for saved work to be taken up again."""
    import hashlib

    return hashlib.sha256(json.dumps(fields, sort_keys=True, default=str).encode()).hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def endpoint_warnings(url: str) -> list[str]:
    """What is unsafe about a model service's address."""
    from urllib.parse import urlsplit

    try:
        u = urlsplit(url.strip())
        host = u.hostname or ""
    except ValueError:
        return ["not an address"]
    out = []
    if u.scheme == "http" and host not in ("localhost", "127.0.0.1", "::1"):
        out.append("keys and texts travel unencrypted")
    if u.username or u.password:
        out.append("the address holds credentials")
    if u.query and any(k in u.query.lower() for k in ("key=", "token=", "secret=")):
        out.append("the address holds a key")
    return out


def work_files(names: list[str], stem: str) -> list[str]:
    """Of a folder's names those that belong to the work on one input: its suffixed files and its work folder."""
    suffixes = ("_glossary.json", "_output.json", "_characters.json", "_work")
    return sorted(n for n in names if any(n == stem + s for s in suffixes))


def purge(spark: SparkSession, folder: str, stem: str) -> list[str]:
    """Deletes from a folder what belongs to the work on one input; the names that went."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {f.getPath().getName(): f.getPath() for f in fs.listStatus(hadoop)}
    gone = work_files(list(found), stem)
    for name in gone:
        fs.delete(found[name], True)
    return gone
