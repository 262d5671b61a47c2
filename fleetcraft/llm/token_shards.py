"""Token ids as binary shards with constant-time access by document.

Documents are range-partitioned and sorted by id; each task encodes its range
and writes shards of bounded size: ``.bin`` holds nothing but ids (16 bits if
the vocabulary allows, else 32), ``.idx`` the index. The index is a minimal
perfect hash over the shard's document ids with a stored 32-bit fingerprint
per id, the row each id leads to, and each row's offset. One lookup is a hash
probe, a fingerprint comparison and a slice of the payload.

Files are named by task attempt; the manifest (written with Spark's commit)
lists those of the attempts that count, so lost executors and speculative
copies leave no trace in the result. Shards go to the shared folder through
pyarrow's file systems, never to a local one.

Index layout, little-endian: 64-byte header (magic, version, bytes per id,
rows, rows without id, different ids, hash levels, hash words), then level
sizes, hash words, fingerprints, first row by hash number, rows by hash
number, document ids by row, offsets by row and end.

Defined results: null text is empty (only the end id); null ids come first and
cannot be looked up; rows that share an id follow one another, ordered by
text hash, and are found together; an empty table gives no shard and no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import file_system, read_bytes, shared_path, utf8, worker_cache
from fleetcraft.llm.mph import PerfectHash

MAGIC, VERSION = b"FCTOKIDX", 1
HEADER = "<8s7q"
#: A shard ends at so many ids, or so many documents.
SHARD_IDS, SHARD_DOCS = 32_000_000, 200_000
#: Different white-space-free stretches of text kept by a Python worker; the cache starts anew beyond it.
CACHE = 800_000
#: Marks that end words; only those that the tokenizer parts from a letter before them are cut off.
_MARKS = ".,!?;:#*$%&|"

MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, first_id long, last_id long"


class WordEncoder:
    """Encodes with the tokenizers library, each different stretch between white space once.

    The tokenizer must replace white space before it splits, and split there;
    then stretches are encoded alone as they are within a text. Where it also
    lower-cases, and cuts between a letter and the marks that follow, stretches
    are looked up in that form; both are read or probed from the tokenizer.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = t = Tokenizer.from_str(blob.decode())
        self.dtype = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(blob).get("normalizer") or {}
        self.lower = any(n.get("type") == "Lowercase" for n in [rules, *rules.get("normalizers", [])])
        #: strings that the library looks for as they are written
        self.special = [a.content.encode() for a in t.get_added_tokens_decoder().values()]
        self.marks = "".join(m for m in _MARKS if t.pre_tokenizer is not None and all(
            [p for p, _ in t.pre_tokenizer.pre_tokenize_str(f"ab{tail}")] == ["ab", tail]
            for tail in (m, m + m, m + "."))).encode()
        #: whether an id ends a run of letters, where the vocabulary marks word ends
        suffix, self.last = (json.loads(blob).get("model") or {}).get("end_of_word_suffix"), None
        if suffix and self.marks:
            self.last = np.zeros(t.get_vocab_size(), dtype=bool)
            self.last[[i for token, i in t.get_vocab().items() if token.endswith(suffix)]] = True
        # kept by the Python worker for the tasks that follow in it
        self.cache: dict[bytes, bytes] = worker_cache(("token ids", hashlib.sha256(blob).digest()))

    def _encode_new(self, new: list[bytes]) -> None:
        """Encode stretches that are not known yet; runs of letters many at a time, told apart by their last tokens."""
        cache, width = self.cache, self.dtype.itemsize
        texts = [w.decode("utf-8", "replace") for w in new]
        letters = [k for k, t in enumerate(texts) if self.last is not None and t.isalpha()]
        for start in range(0, len(letters), 200 * 64):
            groups = [letters[i:i + 200] for i in range(start, min(start + 200 * 64, len(letters)), 200)]
            encoded = self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in g) for g in groups],
                                                       add_special_tokens=False)
            for g, e in zip(groups, encoded):
                ids = np.array(e.ids, dtype=self.dtype)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(g):
                    continue
                raw, at = ids.tobytes(), 0
                for k, end in zip(g, (ends * width).tolist()):
                    cache[new[k]] = raw[at:end]
                    at = end
        rest = [k for k, w in enumerate(new) if w not in cache]
        for start in range(0, len(rest), 4096):
            some = rest[start:start + 4096]
            encoded = self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)
            cache.update((new[k], np.array(e.ids, dtype=self.dtype).tobytes()) for k, e in zip(some, encoded))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as raw little-endian integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, plain = self.cache, []
        for t in texts:
            low = t.lower() if self.lower else t
            plain.append(t if any(s.lower() in low for s in self.special) else low)
        split = [t.split() for t in plain]
        found = [list(map(cache.get, words)) for words in split]
        gaps = [[k for k, e in enumerate(got) if e is None] for got in found]
        missing = {words[k] for words, some in zip(split, gaps) for k in some}
        if missing:
            halves = {}
            for w in missing:
                core = w.rstrip(self.marks)
                if core and core != w and core[-1:].isalpha() and b"<|" not in w:
                    halves[w] = (core, w[len(core):])
            self._encode_new(list({p for w in missing for p in halves.get(w, (w,)) if p not in cache}))
            for w, (core, tail) in halves.items():
                cache[w] = cache[core] + cache[tail]
            for words, got, some in zip(split, found, gaps):
                for k in some:
                    got[k] = cache[words[k]]
        return [b"".join(got) for got in found]


class ShardWriter:
    """One shard: ids go out as they come, the index when it is closed."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, path = file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.stem, self.uri, self.width = f"{path}/{name}", f"{folder}/{name}", width
        self.out = self.fs.open_output_stream(f"{self.stem}.bin", compression=None)
        self.ids: list[int | None] = []
        self.ends = [0]

    def add(self, doc_id: int | None, payload: bytes) -> None:
        self.out.write(payload)
        self.ids.append(doc_id)
        self.ends.append(self.ends[-1] + len(payload) // self.width)

    def close(self) -> tuple[str, int, int, int | None, int | None]:
        self.out.close()
        nulls = sum(i is None for i in self.ids)
        keys = np.array(self.ids[nulls:], dtype=np.int64)
        unique, first, counts = np.unique(keys, return_index=True, return_counts=True)
        table = PerfectHash.build(unique)
        number = table.number(unique)
        rows, repeats = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        rows[number], repeats[number] = first + nulls, counts
        parts = [struct.pack(HEADER, MAGIC, VERSION, self.width, len(self.ids), nulls, len(unique), len(table.sizes),
                             len(table.words)),
                 table.sizes, table.words, table.marks, rows, repeats, keys, np.array(self.ends, dtype=np.int64)]
        with self.fs.open_output_stream(f"{self.stem}.idx", compression=None) as out:
            for part in parts:
                out.write(part if isinstance(part, bytes) else part.tobytes())
        known = self.ids[nulls:]
        return self.uri, len(self.ids), self.ends[-1], known[0] if known else None, known[-1] if known else None


class Shard:
    """Reads one shard."""

    def __init__(self, uri: str):
        self.fs, self.stem = file_system(uri)
        with self.fs.open_input_file(f"{self.stem}.idx") as f:
            blob = f.read()
        magic, version, self.width, n, self.nulls, unique, levels, words = struct.unpack_from(HEADER, blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"not a token index: {uri}.idx")
        at = struct.calcsize(HEADER)

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        sizes, bits, marks = take(levels, "<i8"), take(words, "<u8"), take(unique, "<u4")
        self.table = PerfectHash(sizes, bits, marks)
        self.rows, self.repeats = take(unique, "<i8"), take(unique, "<i8")
        self.keys, self.ends = take(n - self.nulls, "<i8"), take(n + 1, "<i8")
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row (-1: none) and number of rows of each key, by hash and fingerprint alone."""
        at = self.table.find(keys)
        if not len(self.rows):
            return at, np.zeros(len(at), dtype=np.int64)
        return np.where(at >= 0, self.rows[at], -1), np.where(at >= 0, self.repeats[at], 0)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row under a key, from slices of the payload; the key itself is compared, not its hash alone."""
        row, count = (int(x[0]) for x in self.find(np.array([key], dtype=np.int64)))
        if row >= 0 and int(self.keys[row - self.nulls]) != key:
            return []
        with self.fs.open_input_file(f"{self.stem}.bin") as f:
            return [np.frombuffer(f.read_at(int(self.ends[r + 1] - self.ends[r]) * self.width,
                                            int(self.ends[r]) * self.width), dtype=self.dtype)
                    for r in range(row, row + count) if row >= 0]

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every row in order, found through the index: id, offset in the shard, ids."""
        unique = np.unique(self.keys)
        first, counts = self.find(unique)
        by_row: list[int | None] = [None] * (len(self.ends) - 1)
        for key, row, count in zip(unique.tolist(), first.tolist(), counts.tolist()):
            by_row[row:row + count] = [key] * count
        with self.fs.open_input_stream(f"{self.stem}.bin", compression=None, buffer_size=1 << 20) as f:
            for row, key in enumerate(by_row):
                n = int(self.ends[row + 1] - self.ends[row])
                yield key, int(self.ends[row]), np.frombuffer(f.read(n * self.width), dtype=self.dtype)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int | None = 2, shard_ids: int = SHARD_IDS,
                 shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode and write all documents in ascending id order; returns the manifest, one row per shard."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-shards")
    blob = spark.sparkContext.broadcast(read_bytes(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    # the text's hash lets copies under one id be dealt to several tasks
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = WordEncoder(blob.value)
        tail = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        done: list[tuple] = []
        shard = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(start, 256).columns)
                for doc_id, payload in zip(ids, encoder.encode(texts)):
                    if shard is None:
                        shard = ShardWriter(folder, f"shard-{part:06d}-{len(done):04d}-{attempt}",
                                            encoder.dtype.itemsize)
                    shard.add(doc_id, payload + tail)
                    if shard.ends[-1] >= shard_ids or len(shard.ids) >= shard_docs:
                        done.append((part, len(done), *shard.close()))
                        shard = None
        if shard is not None:
            done.append((part, len(done), *shard.close()))
        if done:
            types = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)],
                                             [c.split()[0] for c in MANIFEST.split(", ")])

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def scan_shards(manifest: DataFrame, fields: T.StructType,
                derive: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``doc_id, start`` and what a function says of the ids, per document, read from the files.

    ``start`` counts the ids of all earlier documents. Its running sum is over
    the manifest, a row per shard, not over documents.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = max(1, manifest.count())
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                for key, start, ids in Shard(path).scan():
                    out.append((key, base + start, *derive(ids)))
                    if len(out) >= 512:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return based.repartition(min(shards, 10_000)).mapInArrow(run, schema)


def read_ids(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document."""
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return scan_shards(manifest, fields, lambda ids: (ids.astype(np.int32),))


def read_digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``; the crc is over the ids as little-endian 32-bit integers."""
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return scan_shards(manifest, fields, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """``doc_id, ids`` of a short list of keys; only shards whose id range holds one are opened."""
    wanted = sorted({int(k) for k in keys})
    held = F.lit(False)
    for k in wanted:
        held = held | ((F.col("first_id") <= k) & (F.col("last_id") >= k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = Shard(path)
                found = [(k, ids.astype(np.int32)) for k in wanted for ids in shard.get(k)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[0] for f in found], pa.int64()),
                         pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return manifest.where(held).select("path").mapInArrow(run, "doc_id long, ids array<int>")
