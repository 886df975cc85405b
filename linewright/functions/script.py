"""Script projection: Latin test prose turned into lines that hold kana, Han, dialogue and scene breaks.

Operators for Japanese text find nothing in the test tables.  A fixed chain of
replacements gives such a text the features they look for.  The chain is data; Spark and
any other SQL engine evaluate it alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAIN = (
    (". The ", "。」\n「"), (". To ", "。\n第3章 "), (". And ", "。\n\n"), (". Of ", "。\n◆◆◆\n"), (". In ", "。\n『"), (". ", "。\n"), (", ", "、"),
    (" the ", "は彼女"), (" that ", "と言っ"), (" and ", "しかし"), (" in ", "昨日"), (" of ", "田中さん"), (" on ", "彼"), (" to ", "そして"), (" is ", "１２"), (" for ", "らしい"), (" a ", "てくれ"),
    (" with ", "アレクサンダ"), (" be ", "つまり"), (" or ", "ところで"), ("ing", "の"), ("th", "ッ"), ("He ", "　"),
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def projected(c: Column) -> Column:
    for a, b in CHAIN:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def projected_sql(column: str, newline: str = "chr(10)") -> str:
    for a, b in CHAIN:
        parts = " || ".join(f"{newline}" if x == "\n" else _quoted(x) for x in b.replace("\n", "\0\n\0").split("\0") if x)
        column = f"replace({column}, {_quoted(a)}, {parts})"
    return column
