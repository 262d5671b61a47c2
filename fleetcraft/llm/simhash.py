"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each text gets a 64-bit SimHash over its word shingles. Fingerprints within a
Hamming radius r are linked, found with 2^(r+1)-1 structured bit masks: bit i
carries a non-zero vector a(i) over GF(2)^(r+1), and mask v keeps the bits
with <a(i), v> = 1. Up to r differing bits span at most r dimensions, so some
non-zero v is orthogonal to all of them; under that mask the two fingerprints
are equal. No pair within the radius can be missed.

Equal fingerprints are merged before anything else, so copies cost one row.
A bucket over ``CHUNK`` different fingerprints is dealt out as pairs of
chunks, each a task-sized group; inside a group a breadth-first search
compares a frontier with what it has not reached yet, and emits one edge per
reached fingerprint, never all pairs.

Defined results: null text is empty; a text without words has fingerprint 0
and is linked like any other; a null ``doc_id`` keeps its row, never names a
component, and its component is null only if no linked row has an id;
repeated rows are all returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import map_bytes, store
from fleetcraft.llm.graph import components

SEED = 42
BITS = 64
#: Different fingerprints of one bucket that are searched together; larger buckets go chunk against chunk.
CHUNK = 4096


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text (UTF-8, A-Z lower-cased, words cut at ASCII white space), unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[start:start + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def covering_masks(radius: int) -> list[int]:
    """The masks of the covering family: each pair within ``radius`` bits agrees under one of them."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, columns to keep and ``fp``: the fingerprint's 64 bits as a signed long."""
    def make():
        def one(text: bytes) -> tuple:
            fp = fingerprint(text, shingle)
            return (fp - (1 << 64) if fp >> 63 else fp,)
        return one

    out = map_bytes(docs, text_col, [id_col, *keep], T.StructType([T.StructField("fp", T.LongType())]), make)
    return out.withColumnRenamed(id_col, "doc_id")


def reach(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning star for each set of fingerprints that are linked within one group."""
    edges, left = [], fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                frontier.extend(hit)
                edges.extend((int(root), int(h)) for h in hit)
    return edges


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: np.ndarray, fps: np.ndarray):
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = []
            for group in np.split(fps, cuts):
                if len(group) == 2:
                    if (int(group[0]) ^ int(group[1])).bit_count() <= radius:
                        edges.append((int(group[0]), int(group[1])))
                elif len(group) > 2:
                    edges.extend(reach(group, radius))
            signed = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], ["u", "v"])

        keys, fps = np.empty((0, 4), dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.concatenate([keys, np.stack([c.astype(np.int64) for c in cols[:4]], axis=1)])
            fps = np.concatenate([fps, cols[4].view(np.uint64)])
            if not len(fps):
                continue
            # the last group may go on in the next batch; a group has 2 * CHUNK rows at most
            done = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if done:
                yield emit(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        if len(fps):
            yield emit(keys, fps)

    return run


def links(nodes: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints (``fp``, each once) linked within ``radius`` bits."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                 for t, m in enumerate(signed)]))
    rows = nodes.select("fp", tables.alias("b")).select("b.t", "b.key", "fp")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, ["t", "key"])
    parts = F.ceil(F.col("n") / F.lit(chunk))
    dealt = rows.withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long")))
                      .otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                                          lambda x: x != F.col("c"))))
    groups = (dealt.withColumn("o", other)
              .select(F.col("t").cast("long").alias("t"), "key", F.least("c", "o").alias("i"),
                      F.greatest("c", "o").alias("j"), "fp")
              .repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp"))
    return groups.mapInArrow(_search(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp, root, component_id`` and columns to keep; the smallest id reachable over links of ``radius`` bits.

    ``root``, the component's smallest fingerprint, names components whose rows all lack an id too.
    """
    fps = store(fingerprints(docs, id_col, text_col, shingle, keep), "fingerprints")
    nodes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes.select("fp"), radius, chunk))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "root", "component_id")
    return fps.join(by_fp, "fp", "left").select("doc_id", "fp", "root", "component_id", *keep)


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
