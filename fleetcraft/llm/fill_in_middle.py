"""Fill-in-the-middle: texts cut at two unit boundaries and written as prefix, suffix and middle.

A unit is a word with the white space before it; white space after the last
word is a unit of its own. The two cuts and the form come from a hash of the
document's id, so a lost task repeats its work exactly.

Each text is divided into fixed blocks of bytes. A Fenwick tree over the blocks
holds how many units end in them and how many code points start in them. A cut
after k units is found by binary lifting down the tree to the one block that
holds the k-th end, and by a look inside that block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetcraft.llm.common import utf8

#: Bytes of one block.
BLOCK = 512
#: The markers before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Texts that a task rewrites at a time.
TEXTS = 64

FIELDS = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False),
                       T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                       T.StructField("output", T.BinaryType(), False)])

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def fenwick(counts: np.ndarray) -> list[int]:
    """The tree of the counts: entry i (from 1) holds the sum of the lowbit(i) counts that end with the i-th."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(upto))
    return (upto - upto[at & (at - 1)]).tolist()


class UnitIndex:
    """Unit ends and code points of one UTF-8 text, by block."""

    def __init__(self, raw: bytes, block: int = BLOCK):
        data = np.frombuffer(raw, np.uint8)
        white = _WHITE[data]
        self.block = block
        self.ends = ~white
        self.ends[:-1] &= white[1:]
        if len(raw) and white[-1]:
            self.ends[-1] = True
        self.starts = (data & 0xC0) != 0x80
        cuts = np.arange(0, len(raw), block)
        self.n_blocks = len(cuts)
        count = (lambda mask: np.add.reduceat(mask, cuts, dtype=np.int64)) if len(raw) else (lambda mask: np.zeros(0, np.int64))
        self.unit_tree, self.point_tree = fenwick(count(self.ends)), fenwick(count(self.starts))
        self.n_units = int(np.count_nonzero(self.ends))

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first k units."""
        if k == 0:
            return 0, 0
        at, points = 0, 0
        step = 1 << (self.n_blocks.bit_length() - 1)
        while step:
            to = at + step
            if to <= self.n_blocks and self.unit_tree[to] < k:
                at, k, points = to, k - self.unit_tree[to], points + self.point_tree[to]
            step >>= 1
        first = at * self.block
        end = first + int(np.flatnonzero(self.ends[first:first + self.block])[k - 1]) + 1
        return end, points + int(np.count_nonzero(self.starts[first:end]))


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits from the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def rewrite(raw: bytes, key: str, seed: int, plain_percent: int, spm_percent: int) -> tuple:
    """One text's row of FIELDS."""
    index = UnitIndex(raw)
    n = index.n_units
    h1, h2, h3, h4 = draws(key, seed)
    if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= plain_percent:
        return n, "plain", None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_points), (b, b_points) = index.cut(low), index.cut(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a_points, b_points - a_points, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a_points, b_points - a_points, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                   plain_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its id, units ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` (UTF-8).

    The form is ``plain`` (the text as it is; both lengths null) for empty
    texts, texts that hold a marker, and those whose draw is not under
    ``plain_percent``; of the rest ``spm_percent`` in a hundred are ``spm``,
    the others ``psm``. A null text is an empty one, of no units. A null id
    draws as an empty key. Rows that share an id draw alike, each for its own
    text; repeated rows stay repeated. Very long texts are cut whole. Other
    columns of ``docs`` are not carried. An empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__key"),
                         utf8(text_col).alias("__utf8"))
    schema = T.StructType([source.schema["doc_id"], *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                rows = [rewrite(raw, key, seed, plain_percent, spm_percent) for key, raw in
                        zip(part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist())]
                made = [pa.array(values, type=arrow.field(1 + i).type) for i, values in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *made], schema=arrow)

    return source.mapInArrow(run, schema)


def restore(output="output", form="form") -> F.Column:
    """The text rebuilt from an output (as a string) and its form; the markers in it are all the operator's own."""
    text = F.col(output).cast("string") if isinstance(output, str) else output
    body = F.split(F.substring(text, 4, 2 ** 31 - 1), "<[PSM]>", -1)
    return (F.when(F.col(form) == "psm", F.concat(body[0], body[2], body[1]))
            .when(F.col(form) == "spm", F.concat(body[1], body[2], body[0])).otherwise(text))
