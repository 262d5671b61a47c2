"""Toxicity scores from subword-bag embeddings with a linear softmax (see subword.py).

The classifier is fitted on a bounded sample: of each class the ``per_class``
labelled texts with the smallest hash of their id. Word counts of those texts
alone reach the driver. The class shares of all labels correct the sample's.
Every text is scored whole by one pass over the table.

Defined results: null or empty text, or one without words, gets the model's
constant as its score; null labels and null ids are not learnt from; of rows
that share an id the smallest text is learnt from; without labels of both
classes all scores equal the share of class 1 (0.001 at least, 0.999 at
most); repeated rows are all scored; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm import subword
from fleetcraft.llm.common import map_bytes, map_texts

#: Labelled texts of each class that are learnt from, at most.
PER_CLASS = 2000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, float]:
    """``doc_id, label, text`` of a bounded sample, and the share of label 1 among all labels."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label")))
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    some = None
    for label in (0, 1):
        one = known.where(F.col("__label") == label).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        some = one if some is None else some.unionByName(one)
    # at most twice per_class rows of two numbers
    rows = (docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(some), id_col)
            .groupBy(id_col, "__label").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text")))
    total = sum(counts.values())
    return (rows.select(F.col(id_col).alias("doc_id"), F.col("__label").alias("label"), F.col("__text").alias("text")),
            counts.get(1, 0) / total if total else 0.5)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS,
        id_col: str = "doc_id", text_col: str = "text") -> subword.Folded:
    """Train on a sample of ``labels`` rows (the caller chooses which rows may be learnt from)."""
    sample, prior = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    fields = T.StructType([T.StructField("words", T.ArrayType(T.StringType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType()))])
    bags = map_bytes(sample, "text", ["doc_id", "label"], fields,
                     lambda: lambda t: subword.count_words(t.decode("utf-8", "replace")))
    rows = bags.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").toArrow()
    lists, counts = rows.column("words").combine_chunks(), rows.column("counts").combine_chunks()
    words = lists.flatten().dictionary_encode()
    doc_at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return subword.train(words.dictionary.to_pylist(), words.indices.to_numpy(), doc_at,
                         counts.flatten().to_numpy().astype(float), rows.column("label").to_numpy(), prior)


def score(docs: DataFrame, model: subword.Folded, keep: list[str], text_col: str = "text",
          name: str = "score") -> DataFrame:
    """``keep`` columns plus the probability of class 1."""
    table = docs.sparkSession.sparkContext.broadcast(model.table.astype(np.float32))
    bias = model.bias

    def make():
        scorer = subword.Scorer(subword.Folded(table.value, bias))

        def some(texts: list[bytes]) -> list[tuple]:
            return [(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))),)
                    for z in scorer.logits([t.decode("utf-8", "replace") for t in texts])]
        return some

    return map_texts(docs, text_col, keep, T.StructType([T.StructField(name, T.DoubleType())]), make)
