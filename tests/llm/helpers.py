"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def prose(rnd: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def lined(words: list[str], per_line: int = 12) -> str:
    return "\n".join(" ".join(words[i:i + per_line]) for i in range(0, len(words), per_line))


def awkward_docs() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rnd = random.Random(3)
    long_text = lined(prose(rnd, 15_000))
    copy = lined(prose(rnd, 150))
    rows = [(1, copy, "en", "a"), (2, copy, "en", "a"), (2, copy, "en", "a"), (3, None, "en", "a"), (4, "", "en", "b"),
            (None, copy, "en", "b"), (None, None, None, None), (5, long_text, None, "b"), (6, long_text, "en", None),
            (7, "  \n\t\n ", "de", "b"), (8, "one", "de", "c"), (9, "é 漢字 😀\x00 ​", "de", "c"), (9, "other text", "fr", "c"),
            (10, copy.upper(), "en", "a"), (11, "a b", "en", "a")]
    rows += [(100 + k, lined(prose(rnd, 60 + k)), "en", "a") for k in range(20)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def docs_frame(spark, rows: list[tuple] | None = None, extra: bool = True):
    df = spark.createDataFrame(awkward_docs() if rows is None else rows, DOCS).repartition(3)
    if extra:
        for name in ("fp", "score", "ids", "spans", "digest", "n", "u", "text_hash", "n_removed", "g"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
