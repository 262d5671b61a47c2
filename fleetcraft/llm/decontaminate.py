"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some of the positions of a token window and ignore the
others, so a substituted token leaves some mask's hash unchanged. Hashes of all
benchmark windows form an index; every window of every text is looked up in it.
Around each hit the benchmark item is laid over the text at that offset. The
text holds the item if any aligned stretch there has ``least`` equal tokens (or
all of a shorter item) and is equal in at least four of five positions, that
is, its sum of +1 per equal token and ``PENALTY`` per substitution is not
negative. The longest such stretch has the most equal tokens (one with more
could be lengthened past it), so it decides, cut to its first and last equal
token. The masks are a set cover: chosen one after another so that of the
passages of each length and number of substitutions that the check accepts,
placed anywhere, at least nine in ten leave some mask's hash unchanged (the
worst case, 16 tokens with three substitutions: 0.97). The others are not found.

The benchmark is the stated query set. It is read in blocks of at most
``BLOCK_TOKENS`` tokens. The index of one block is broadcast (its size is
bounded by that), makes one pass over the texts, and is released when its
matches are written, so neither the driver nor the plan grows with the
benchmark. Nothing of the texts is shuffled, so frequent passages meet no hot key.

Defined results: tokens are runs of word characters, lower-cased; null or empty
texts match nothing; an item of fewer than ``SHORTEST`` tokens is held by a text
that consists of it, as ordinary text would hold it elsewhere; items shorter
than a mask are looked up whole; an item without a token is held by none; repeated rows are all returned; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcraft.llm.common import shared_path, utf8

#: Positions looked at (1) and ignored (0). Each mask begins and ends with 1.
MASKS = ("1110100111", "11101111", "111100010011")
SHORTEST, LEAST, PENALTY = 8, 13, -4
BLOCK_TOKENS = 300_000
_SPAN = max(map(len, MASKS))
RESULT = "doc_id long, item_id long, doc_token long, n_aligned int, n_equal int, item_tokens int"


def tokens_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def _hashes(ids: np.ndarray, offsets: tuple[int, ...], starts: np.ndarray) -> np.ndarray:
    h = np.full(len(starts), len(offsets), dtype=np.uint64)
    for o in offsets:
        h = (h ^ ids[starts + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _window_starts(ids: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Starts of windows whose looked-at tokens are all in the vocabulary."""
    n = len(ids) - offsets[-1]
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    known = ids > 0
    whole = known[:n].copy()
    for o in offsets[1:]:
        whole &= known[o:o + n]
    return np.flatnonzero(whole)


class Index:
    """Hashes of all masked windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        #: items that a text must consist of, by their tokens
        self.short: dict[tuple[str, ...], list[int]] = {}
        for item_id, tokens in items:
            if len(tokens) < SHORTEST:
                self.short.setdefault(tuple(tokens), []).append(item_id)
        items = [i for i in items if len(i[1]) >= SHORTEST]
        self.vocabulary: dict[str, int] = {}
        ids, self.item_ids, starts, sizes = [], [], [], []
        for item_id, tokens in items:
            starts.append(len(ids))
            sizes.append(len(tokens))
            self.item_ids.append(item_id)
            ids += [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens] + [0] * _SPAN
        self.ids, self.starts, self.sizes = (np.array(x, dtype=np.int64) for x in (ids, starts, sizes))
        #: per family of windows: positions looked at, sorted hashes, and the item token where each begins
        self.families: list[tuple[tuple[int, ...], np.ndarray, np.ndarray]] = []
        for mask in MASKS:
            offsets = tuple(i for i, c in enumerate(mask) if c == "1")
            self._add(offsets, _window_starts(self.ids, offsets))
        for size in sorted({s for s in sizes if s < _SPAN}):
            self._add(tuple(range(size)), self.starts[self.sizes == size])

    def _add(self, offsets: tuple[int, ...], at: np.ndarray) -> None:
        h = _hashes(self.ids, offsets, at)
        order = np.argsort(h, kind="stable")
        self.families.append((offsets, h[order], at[order]))

    def verify(self, ids: np.ndarray, item: int, at: int, least: int) -> tuple[int, int, int] | None:
        """Start in the text, aligned and equal tokens of the longest stretch equal in four of five, if it holds enough."""
        size, start = int(self.sizes[item]), int(self.starts[item])
        low, high = max(0, -at), min(size, len(ids) - at)
        equal = ids[at + low:at + high] == self.ids[start + low:start + high]
        sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, PENALTY))])
        # for each end the first begin whose prefix sum is not above the end's
        begins = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
        end = int((np.arange(len(sums)) - begins).argmax())
        held = np.flatnonzero(equal[begins[end]:end]) + int(begins[end])
        if len(held) < max(1, min(least, size)):
            return None
        return at + low + int(held[0]), int(held[-1] - held[0]) + 1, len(held)

    def search(self, texts: list[list[str]], least: int) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item id, text token, aligned, equal, item tokens): the best stretch per text and item."""
        get = self.vocabulary.get
        lists = [np.fromiter((get(t, 0) for t in tokens), dtype=np.int64, count=len(tokens)) for tokens in texts]
        gap = np.zeros(_SPAN, dtype=np.int64)
        line = np.concatenate([x for ids in lists for x in (ids, gap)]) if lists else gap
        begins = np.concatenate([[0], np.cumsum([len(ids) + _SPAN for ids in lists])])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen = set()
        for hit in self._located(line, begins):
            if hit in seen:
                continue
            seen.add(hit)
            text, item, at = hit
            found = self.verify(lists[text], item, at, least)
            if found and found[2] > best.get((text, item), (0, 0, 0))[2]:
                best[text, item] = found
        whole = [(k, item, 0, len(t), len(t), len(t)) for k, t in enumerate(texts) if len(t) < SHORTEST
                 for item in self.short.get(tuple(t), ())]
        return whole + [(text, self.item_ids[item], *found, int(self.sizes[item]))
                        for (text, item), found in sorted(best.items())]

    def _located(self, line: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Hits in texts laid end to end: text number, item number, text token at which the item would begin."""
        for offsets, table, at in self.families:
            starts = _window_starts(line, offsets)
            if not len(starts) or not len(table):
                continue
            h = _hashes(line, offsets, starts)
            low = np.searchsorted(table, h, "left")
            found = np.flatnonzero((low < len(table)) & (table[np.minimum(low, len(table) - 1)] == h))
            high = np.searchsorted(table, h[found], "right")
            texts = np.searchsorted(begins, starts[found], "right") - 1
            for k, text, end in zip(found.tolist(), texts.tolist(), high.tolist()):
                where = int(starts[k] - begins[text])
                for j in range(int(low[k]), end):
                    item = int(np.searchsorted(self.starts, at[j], "right")) - 1
                    yield text, item, where - int(at[j] - self.starts[item])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, n = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        tokens = tokens_of(row[1] or "")
        if not tokens:
            continue
        block.append((row[0], tokens))
        n += len(tokens)
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text", least: int = LEAST,
             block_tokens: int = BLOCK_TOKENS, hash_col: str | None = None) -> DataFrame:
    """``doc_id, item_id, doc_token, n_aligned, n_equal, item_tokens``: each text and the items it holds.

    With ``hash_col`` the text's xxhash64 stands last under that name.
    """
    spark: SparkSession = docs.sparkSession
    text = utf8(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                         *([F.xxhash64(text).alias(hash_col)] if hash_col else []))
    result = f"{RESULT}, {hash_col} long" if hash_col else RESULT
    names = [c.split()[0] for c in result.split(", ")]
    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * bool(hash_col)
    paths = []
    for block in _blocks(benchmark, item_id_col, item_text_col, block_tokens):
        # its plain parts: executors need no copy of the package to read them
        shared = spark.sparkContext.broadcast(vars(Index(block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.__new__(Index)
            index.__dict__.update(shared.value)
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    ids, texts, *hashes = (c.to_pylist() for c in batch.slice(start, 256).columns)
                    found = index.search([tokens_of(t.decode("utf-8", "replace")) for t in texts], least)
                    if found:
                        columns = list(zip(*((ids[f[0]], *f[1:], *(h[f[0]] for h in hashes)) for f in found)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        paths.append(shared_path(spark, "overlaps"))
        source.mapInArrow(run, result).write.parquet(paths[-1])
        shared.unpersist()
    return spark.read.schema(result).parquet(*paths) if paths else spark.createDataFrame([], result)
