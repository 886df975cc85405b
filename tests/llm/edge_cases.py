"""Rows with nulls, empty, blank and long texts, ties, repeated rows and clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), T.StructField("label", T.StringType()), T.StructField("g", T.LongType())])

BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "one two three", "One TWO three", "a b c d e", "a b c d e f", BASE, BASE, BASE.replace("word30", "changed"), BASE.upper(),
    "x y z " * 20, "x y z " * 21, "ünï çödé wörds ≠ äöü 😀 and more of them\nünï çödé wörds\n\nünï çödé wörds\n", "long " * 30_000, "l" * 100_000, "a b c d e f g",
    "#tag *x* $5 50% a&b a|b <p>\n<p>\n<p>", BASE + " " + BASE,
]


def frame(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 7, "x", i) for i, t in enumerate(TEXTS)], SCHEMA)


def repeated_rows():
    """(doc_id, text, source): rows that repeat whole, ids that repeat with other texts, rows without an id."""
    near = BASE.replace("word30", "changed")
    other = " ".join(f"other{i}" for i in range(60))
    return [
        (1, BASE, "s"), (1, other, "s"), (2, near, "s"), (3, other.replace("other3 ", "third "), "s"), (4, "alone " * 12, "s"), (4, "alone " * 12, "s"), (4, "", "s"), (5, None, None), (5, None, None), (6, "", "s"), (6, near, "s"),
        (None, BASE, "s"), (None, "no id here " * 5, "s"), (None, "no id here " * 5, "s"), (None, None, None), *[(7, BASE.replace("word5 ", "fifth "), "s")] * 10,
    ]


def repeated(spark):
    return spark.createDataFrame([(i, t, "en", s, 7, "x", 1) for i, t, s in repeated_rows()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
