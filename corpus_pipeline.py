"""Training-data pipeline: five stages, each written as Parquet and read again as the next one's input.

Toxic documents are rejected; repeated runs of lines are deleted, and documents
left without a word with them; of each group of near-duplicates one row stays; documents that hold a benchmark passage are
dropped; the rest is encoded, and decoded as a check. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcraft.llm import decontaminate, line_dedup, sentencepiece, simhash, toxicity
from fleetcraft.llm.common import store, utf8
from fleetcraft.llm.queries import fold
from fleetcraft.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; learnt from the labels that op1 learns from.

    A null or empty text scores by the model's constant alone and stays unless
    that is one half or more. Rows without an id are scored, not learnt from.
    Repeated rows and rows that share an id are each judged by their own text.
    All columns pass through, whatever their names. An empty table stays empty.
    """
    labels = load(spark, sf_dir, "labels", ["doc_id", "toxic"]).where(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, docs.columns, name="__toxic").where(F.col("__toxic") < 0.5).drop("__toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated runs; a document that loses all its words goes.

    Null and empty texts and texts without words stay as they are. A null id
    counts as the smallest. Rows of one id and text are one text and share its
    fate, so they stay or go together. ``n_chars`` follows a changed text where
    the table has it; all other columns pass through, whatever their names. An
    empty table stays empty.
    """
    counts = ("__lines", "__removed")
    found = line_dedup.dedup_lines(docs, counts=counts).where((F.col(counts[1]) == 0) | (F.col(counts[1]) < F.col(counts[0])))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                                 .otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, rows without an id last, of equals the smallest text hash.

    A group whose rows all lack an id shrinks to one row too, and so do texts
    that share the smallest id, and repeated rows of one id and text (the one
    that stays has the least hash over all columns). Null, empty and wordless
    texts are alike, hence one group. All columns pass through, whatever their
    names. An empty table stays empty.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(utf8("text")).alias("__hash"))
    members = store(simhash.near_duplicates(keyed, shingle=3, radius=3, keep=("__hash",)), "near-members")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__hash").alias("hash"))
    first = members.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    stay = store(first.select(F.col("first.id").alias("__id"), F.col("first.hash").alias("__hash"), F.col("n").alias("__n")),
                 "near-first")
    same = docs["doc_id"].eqNullSafe(stay["__id"]) & (F.xxhash64(utf8(docs["text"])) == stay["__hash"])
    kept = docs.join(stay, same)
    # rows of one id and text: only in groups of several rows
    again = kept.where("__n > 1").withColumn("__row", F.struct(*docs.columns))
    one = (again.groupBy("__id", "__hash").agg(F.min_by("__row", F.xxhash64(*docs.columns)).alias("__row"))
           .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
    return kept.where("__n = 1").select(*docs.columns).unionByName(one)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; a row goes for its own text alone, whatever its id.

    Null and empty texts hold none and stay, rows without an id are judged like
    others, repeated rows stay or go together. All columns pass through,
    whatever their names. An empty table, or an empty benchmark, changes nothing.
    """
    hits = decontaminate.overlaps(docs, load(spark, sf_dir, "benchmark", ["item_id", "text"]), hash_col="__hash")
    hits = store(hits.select(F.col("doc_id").alias("__id"), "__hash").distinct(), "benchmark-hits")
    same = docs["doc_id"].eqNullSafe(hits["__id"]) & (F.xxhash64(utf8(docs["text"])) == hits["__hash"])
    return docs.join(hits, same, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them; ``exact`` where that is the text.

    One row per row, also for repeated rows and rows without an id; a null text
    is an empty one, of no ids. Other columns are not carried. An empty table
    gives an empty table.
    """
    done = sentencepiece.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "text"])
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256",
                       (F.sha2(utf8("text"), 256) == F.col("decoded_sha256")).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates),
          ("decontamination", drop_benchmark), ("sentencepiece", encode)]

#: The first and third stage are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
