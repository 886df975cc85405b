"""Texts as ordered lines: scan, classes, features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What may fill a line that holds nothing to read.
FILLER = "「」『』（）【】、。！？…―ー・～　 "
# Patterns of line features.
NAME_HINT = r"(?:[一-龥]{2,6}|[ァ-ヴー]{3,}|[ぁ-ん]{3,})(?:さん|様|さま|くん|君|ちゃん|先輩|先生|師匠)"
KANJI_NAME = r"[一-龥]{2,6}"
KATAKANA_LONG = r"[ァ-ヴー]{4,}(?:・[ァ-ヴー]{2,})*"
TIME_ANCHOR = r"昨日|今日|明日|翌日|その後|その時|あの時|当時|先ほど|先程|さっき"
SPEECH_VERB = r"と(?:言っ|言われ|呟|囁|叫|怒鳴|答え|返事|尋ね|訊ね|問う|続け|付け加え)"


@dataclass(frozen=True)
class Boundaries:
    """Patterns of lines that are not prose, tried on the trimmed line; the defaults are our own, packs bring theirs."""

    scene_break: tuple[str, ...] = (r"^(?:[◆◇] ?){3,}$", r"^(?:[*~=-] ?){3,}$")
    chapter_heading: tuple[str, ...] = (r"^第[0-9]+章", r"^(?:Chapter|Part) [0-9]+(?:[.:]|$)")
    metadata: tuple[str, ...] = (r"^(?:©|ISBN)",)


def raw_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every line, blank ones too, numbered from 1 in its document."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def scan_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Trimmed lines that are not blank, numbered from 1 after blank ones are gone; numbering needs no shuffle."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.unicode_trim), lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def _any(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def line_type(line: Column, b: Boundaries = Boundaries()) -> Column:
    """blank, metadata, scene_break, chapter_heading, dialogue or narration: the first that fits."""
    s = T.unicode_trim(line)
    return (
        F.when(s == "", "blank").when(_any(s, b.metadata), "metadata").when(_any(s, b.scene_break), "scene_break").when(_any(s, b.chapter_heading), "chapter_heading")
        .when(s.rlike("^[「『]"), "dialogue").otherwise("narration")
    )


def is_skippable(line: Column) -> Column:
    s = T.unicode_trim(F.regexp_replace(line, "[　\n]", ""))
    return (F.length(s) < 2) | s.rlike(f"^[{FILLER}]+$")


def features(line: Column) -> dict[str, Column]:
    return {
        "dialogue": T.unicode_trim(line).rlike("^[「『]"), "has_quote": line.rlike("[「『]"), "name_hint": line.rlike(NAME_HINT), "katakana_long": line.rlike(KATAKANA_LONG),
        "kanji": line.rlike(KANJI_NAME), "time_anchor": line.rlike(TIME_ANCHOR), "speech_verb": line.rlike(SPEECH_VERB),
    }


def batch_ids(lines: DataFrame, size: int) -> DataFrame:
    """batch_id by the line's number."""
    return lines.withColumn("batch_id", F.floor((F.col("line_no") - 1) / size).cast("long"))


def neighbours(lines: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """above and follow: the k trimmed lines on either side, padded with empty ones."""
    w = Window.partitionBy(key).orderBy("line_no")
    trimmed = T.unicode_trim(F.col("line"))
    up, down = F.collect_list(trimmed).over(w.rowsBetween(-k, -1)), F.collect_list(trimmed).over(w.rowsBetween(1, k))
    pad = lambda a: F.array_repeat(F.lit(""), (F.lit(k) - F.size(a)).cast("int"))
    return lines.withColumns({"above": F.concat(pad(up), up), "follow": F.concat(down, pad(down))})
