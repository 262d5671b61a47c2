"""Line dedup: winnowed line fingerprints, joined positions, extended matches.

A text is its sequence of lines that hold a word. From each line the shortest
stretch of lines on from it with ``min_words`` words is a window, and likewise
back from it. Of every window the line with the smallest hash is selected: any
two runs of equal lines with ``min_words`` words or more contain equal windows
and so select the same line, which guarantees a common fingerprint.

Fingerprints that occur once are dropped. Positions that share one are joined
through the windows around them: windows going forward extend a match to the
right and windows going back to the left, and together they cover a common run
from its first to its last line. Each window after the first equal one (by
document id, text hash, line) is a repeat, and the lines of repeats are deleted.

So a line is deleted exactly if it lies in a run of ``min_words`` words or more
that is equal, line by line, to a run that begins earlier. The earliest copy of
every line stays. Matches are made with the first copy only, never with all
pairs of copies; grouping combines on the map side and the joins are plain
equi-joins that AQE can split.

Defined results: lines are compared without white space around them; null text
is empty; texts of fewer than ``min_words`` words are untouched, as are lines
without words; a text all of whose words are deleted becomes empty; null ids
count as smallest; rows with the same id and text are one text and share its
fate; an empty table gives an empty result; columns other than the text pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import map_bytes, store, utf8

MIN_WORDS = 50
#: Tasks that the positions of one fingerprint, or of one window, are dealt to.
SALTS = 8


def windows(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, bytes, int, int]]:
    """(fingerprint, content digest, first line, last line) of the windows of a text, lines counted from 0."""
    at, digests, words = [], [], []
    for k, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            at.append(k)
            words.append(n)
            digests.append(xxhash.xxh3_128_digest(line.strip()))
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if sums[-1] < min_words:
        return []
    lines = np.arange(len(at))
    ahead = np.searchsorted(sums, sums[:-1] + min_words, "left") - 1
    back = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    fits = ahead < len(at)
    spans = {*zip(lines[fits].tolist(), ahead[fits].tolist()), *((i, j) for i, j in zip(back.tolist(), lines.tolist())
                                                                 if i >= 0)}
    out = []
    for i, j in sorted(spans):
        chosen = min(digests[i:j + 1])
        out.append((int.from_bytes(chosen[:8], "big", signed=True), xxhash.xxh3_128_digest(b"".join(digests[i:j + 1])),
                    at[i], at[j]))
    return out


def delete_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of the spans, its lines with words, and how many of them went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    for first, last in spans:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone) > 0
    wordy = [bool(x.strip(" \t\n\r\v\f")) for x in lines]
    removed = sum(w and bool(g) for w, g in zip(wordy, gone))
    if not removed:
        return text, sum(wordy), 0
    rest = [x for x, w, g in zip(lines, wordy, gone) if not (w and g)]
    return "\n".join(rest) if sum(wordy) > removed else "", sum(wordy), removed


def _salted_join(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Inner join to one row per key; the rows of a key are dealt to ``SALTS`` tasks, and each gets the key's row."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    copies = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_hash, spans``: the line spans of each text that repeat an earlier run."""
    item = T.ArrayType(T.StructType([T.StructField("fp", T.LongType()), T.StructField("digest", T.BinaryType()),
                                     T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(utf8(text_col)).alias("text_hash"))

    def make():
        return lambda text: ([{"fp": f, "digest": d, "first": i, "last": j} for f, d, i, j in windows(text, min_words)],)

    found = store(map_bytes(keyed, "text", ["doc_id", "text_hash"], T.StructType([T.StructField("w", item)]), make),
                  "line-windows")
    every = found.select("doc_id", "text_hash", F.explode("w").alias("w")).select("doc_id", "text_hash", "w.*")
    # a window's fingerprint counts once per position: windows that select the same line are one occurrence or overlap
    common = every.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    shared = store(_salted_join(every, common, "fp"), "shared-windows")
    place = F.struct("doc_id", "text_hash", "first")
    first = (shared.groupBy("digest").agg(F.min(place).alias("origin"), F.max(place).alias("latest"))
             .where("latest > origin").select("digest", "origin"))
    later = _salted_join(shared, first, "digest").where(place > F.col("origin"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns with repeated runs deleted from the text, plus the numbers of lines with words and of lines removed,
    under the names in ``counts``; columns of ``docs`` that have these names are not carried."""
    spans = repeats(docs, id_col, text_col, min_words).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    met = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(utf8(text_col)) == F.col("__hash")),
                    "left").drop("__id", "__hash")
    columns = [c for c in docs.columns if c not in counts]
    source = met.select(*columns, "__spans")
    schema = T.StructType([source.schema[c] for c in columns]
                          + [T.StructField(c, T.LongType()) for c in counts])
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                spans = part.column(len(columns)).to_pylist()
                done = [delete_lines(t or "", [(s["first"], s["last"]) for s in found or ()])
                        for t, found in zip(texts, spans)]
                out = [part.column(i).cast(arrow.field(i).type) for i in range(len(columns))]
                out[at] = pa.array([None if t is None else d[0] for t, d in zip(texts, done)], arrow.field(at).type)
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                    schema=arrow)

    return source.mapInArrow(run, schema)
