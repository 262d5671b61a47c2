"""Offset-preserving SentencePiece (BPE) encoding, and decoding.

Encoding normalises a text by longest-prefix lookup in the model's compiled
character map (a double-array trie), noting for every normalised character the
source bytes it came from; merges pairs by score, leftmost first; and projects
every piece back to a byte span of the source. Ids equal the reference
library's, and spans tile the whole source.

A text is cut where no piece of the vocabulary can cross (between a word's end
and the next white-space mark, and between word characters and others where
the vocabulary never mixes them). Merges on either side are then independent,
so each different cut is merged once per task and kept in a bounded cache.

Defined results: null text is empty; empty text has no ids; ill-formed UTF-8
becomes U+FFFD; repeated rows are all returned; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetcraft.llm.common import map_texts, read_bytes, worker_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Different cuts of text kept by a Python worker; the cache starts anew beyond it.
CACHE = 200_000
#: A cut of more characters is merged with a heap and not kept.
SHORT = 64


def _fields(blob: bytes):
    """The (number, value) pairs of one protocol-buffer message."""
    at, end = 0, len(blob)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = blob[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    while at < end:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = blob[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = blob[at:at + size], at + size
        yield key >> 3, value


class CharMap:
    """Longest-prefix replacement through the compiled map of a model."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size:]
        self.known: dict[bytes, tuple[bytes, int] | None] = {}

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that starts here, and the key's length."""
        units, found, start = self.units, None, at
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        while at < len(source):
            b = source[at]
            node ^= b
            if node >= len(units) or units[node] & 0x800000FF != b:
                break
            unit, at = units[node], at + 1
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, at - start)
        if found is None:
            return None
        value = self.strings[found[0]:self.strings.index(b"\0", found[0])]
        return value, found[1]


class Model:
    """A BPE model file: pieces, scores and normalisation rules."""

    def __init__(self, blob: bytes):
        self.digest = hashlib.sha256(blob).digest()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.byte_fallback, self.unk_surface = False, " ⁇ "
        self.dummy_prefix = self.squeeze = self.escape = True
        charsmap, model_type = b"", 1
        for number, value in _fields(blob):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                model_type, self.byte_fallback = f.get(3, 1), bool(f.get(35, 0))
                self.unk_surface = f[44].decode() if 44 in f else self.unk_surface
                if f.get(24):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                f = dict(_fields(value))
                charsmap = f.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(f.get(i, 1)) for i in (3, 4, 5))
        if model_type != 2 or USER in self.kinds or UNUSED in self.kinds or not self.escape or not self.byte_fallback:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are supported")
        self.charmap = CharMap(charsmap) if charsmap else None
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        #: rank of a piece: 0 merges first; equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {self.pieces[i]: order[scores[i]] for i in normal}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL
                    else self.unk_surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
                    for p, k in zip(self.pieces, self.kinds)]
        #: per id: source bytes where a mark stands for one space, characters, and whether it is a byte piece
        self.sizes = np.array([len(r) for r in self.raw])
        self.chars = np.array([1 if k == BYTE else len(p) for p, k in zip(self.pieces, self.kinds)])
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.inside = np.array([k == BYTE and 0x80 <= r[0] < 0xC0 for r, k in zip(self.raw, self.kinds)])
        inner = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p for p in inner):
            self.cuts = None
        else:
            odd = re.escape("".join(sorted({c for p in inner for c in p if c.isalnum() and not c.isalpha()
                                            and not c.isdecimal()})))
            letter, other = rf"[^\W\d_{odd}]", rf"(?:(?!{SPACE})[\W\d_{odd}])"
            mixed = re.compile(rf"{letter}{other}|{other}{letter}")
            words = rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
            self.cuts = re.compile(words if any(mixed.search(p) for p in inner)
                                   else rf"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+")

    # normalisation -------------------------------------------------------------------------------------------

    def normalise(self, source: bytes) -> tuple[str, list[int] | None]:
        """The normalised text and, for each of its characters and its end, the source byte where it starts.

        None instead of a list: every character is the source's own, but for a
        leading mark that stands for nothing and marks that stand for spaces.
        """
        if not source:
            return "", None
        text = source.decode("utf-8", "replace")
        if self.charmap is None and not self.squeeze and SPACE not in text and "�" not in text:
            return SPACE * self.dummy_prefix + text.replace(" ", SPACE), None
        if self.charmap is None and "�" not in text:
            units = [(c, len(c.encode())) for c in text]
        else:
            units = self._units(source)
        out: list[str] = []
        starts: list[int] = []
        at, k = 0, 0
        if self.squeeze:
            while k < len(units) and units[k][0] == " ":
                at, k = at + units[k][1], k + 1
            if k == len(units):
                return "", [len(source)]
        if self.dummy_prefix:
            out.append(SPACE)
            starts.append(at)
        after_space = self.squeeze
        for new, size in units[k:]:
            if after_space:
                new = new.lstrip(" ")
            for c in new:
                out.append(SPACE if c == " " else c)
                starts.append(at)
            if new:
                after_space = new[-1] == " "
            at += size
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out and out[-1] == SPACE:
                at = starts[-1]
                out.pop()
                starts.pop()
        starts.append(at)
        return "".join(out), starts

    def _units(self, source: bytes) -> list[tuple[str, int]]:
        """Each replaced or copied stretch of the source: its new text and its length in bytes."""
        units, at = [], 0
        while at < len(source):
            if self.charmap is not None and (hit := self.charmap.longest(source, at)):
                units.append((hit[0].decode("utf-8", "replace"), hit[1]))
                at += hit[1]
                continue
            b = source[at]
            size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            try:
                units.append((source[at:at + size].decode(), size))
                at += size
            except UnicodeDecodeError:
                units.append(("�", 1))
                at += 1
        return units

    # merging -------------------------------------------------------------------------------------------------

    def merge(self, cut: str) -> list[str]:
        """The pieces of one cut: the best-scored neighbouring pair is joined until none is left."""
        rank, parts = self.rank, list(cut)
        if len(parts) > SHORT:
            return self._merge_long(parts)
        none = len(rank)
        get = rank.get
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            new = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + new, none)
            if i < len(pairs):
                pairs[i] = get(new + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if (r := rank.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or j >= n or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, b, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def merged_ids(self, cut: str) -> tuple[tuple[int, ...], str]:
        """The ids of one cut, also as text."""
        ids: list[int] = []
        for piece in self.merge(cut):
            at = self.ids.get(piece)
            if at is None:
                ids.extend([self.byte_ids[b] for b in piece.encode()])
            else:
                ids.append(at)
        return tuple(ids), ",".join(map(str, ids))


class Merger:
    """Merges many short cuts side by side, a row of symbols each; the same result as Model.merge()."""

    def __init__(self, model: Model):
        self.model, n = model, len(model.pieces)
        single = sorted({c for p in model.ids for c in p})
        symbols = dict(model.ids)
        for c in single:
            symbols.setdefault(c, n + len(symbols))
        #: symbol of a character; characters outside the vocabulary share one that merges with nothing
        self.none = n + len(symbols) + len(single)
        self.of_char = np.full(0x110000, self.none, dtype=np.int64)
        for c in single:
            self.of_char[ord(c)] = symbols[c]
        self.base = self.none + 1
        pairs = sorted((symbols[p[:k]] * self.base + symbols[p[k:]], model.rank[p], i)
                       for p, i in model.ids.items() for k in range(1, len(p))
                       if p[:k] in symbols and p[k:] in symbols)
        self.keys, self.ranks, self.joined = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.last = len(model.rank)
        self.ids = list(range(n))
        self.names = [str(i) for i in range(n)]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``last`` if it joins to nothing) and the piece it joins to."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.last), self.joined[at]

    def merge(self, cuts: list[str]) -> list[tuple[tuple[int, ...], str]]:
        """As Model.merged_ids() of each cut, which may have ``SHORT`` characters at most."""
        sizes = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        order = np.argsort(sizes, kind="stable")
        out: list = [None] * len(cuts)
        for start in range(0, len(order), 4096):
            rows = order[start:start + 4096]
            for row, entry in zip(rows.tolist(), self._merge_rows([cuts[r] for r in rows.tolist()], sizes[rows])):
                out[row] = entry
        return out

    def _merge_rows(self, cuts: list[str], sizes: np.ndarray) -> list[tuple[tuple[int, ...], str]]:
        n, width = len(cuts), int(sizes.max()) + 1
        inside = np.arange(width) < sizes[:, None]
        chars = np.frombuffer("".join(cuts).encode("utf-32-le"), dtype=np.uint32)
        symbol = np.full((n, width), self.none, dtype=np.int64)
        symbol[inside] = self.of_char[chars]
        rank = np.full((n, width), self.last, dtype=np.int64)
        joined = np.zeros((n, width), dtype=np.int64)
        rank[:, :-1], joined[:, :-1] = self.look(symbol[:, :-1], symbol[:, 1:])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        at = np.arange(n)
        while len(at):
            j = rank[at].argmin(axis=1)
            going = rank[at, j] < self.last
            at, j = at[going], j[going]
            k = after[at, j]
            symbol[at, j] = joined[at, j]
            inside[at, k] = False
            rank[at, k] = self.last
            right = after[at, k]
            after[at, j] = right
            some = right < width
            before[at[some], right[some]] = j[some]
            rank[at[~some], j[~some]] = self.last
            a, b, c = at[some], j[some], right[some]
            rank[a, b], joined[a, b] = self.look(symbol[a, b], symbol[a, c])
            left = before[at, j]
            some = left >= 0
            a, b, c = at[some], left[some], j[some]
            rank[a, b], joined[a, b] = self.look(symbol[a, b], symbol[a, c])
        plain = ~((symbol >= len(self.ids)) & inside).any(axis=1)
        inside[~plain] = False
        flat = symbol[inside].tolist()
        ids, names = list(map(self.ids.__getitem__, flat)), list(map(self.names.__getitem__, flat))
        ends = np.cumsum(inside.sum(axis=1)).tolist()
        out, start = [], 0
        for cut, end, ok in zip(cuts, ends, plain.tolist()):
            # characters outside the vocabulary are spelled in bytes
            out.append((tuple(ids[start:end]), ",".join(names[start:end])) if ok else self.model.merged_ids(cut))
            start = end
        return out


class Encoder:
    """Encodes texts with a bounded cache of cuts."""

    def __init__(self, model: Model):
        # kept by the Python worker for the tasks that follow in it
        self.model, self.cache = model, worker_cache(("piece cuts", model.digest))
        held = worker_cache(("piece merger", model.digest))
        if "merger" not in held:
            held["merger"] = Merger(model)
        self.merger: Merger = held["merger"]

    def entries(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """Of each normalised text, the ids of its cuts, in order."""
        model, cache = self.model, self.cache
        if model.cuts is None:
            return [[model.merged_ids(t)] if t else [] for t in texts]
        if len(cache) > CACHE:
            cache.clear()
        cuts = [model.cuts.findall(t) for t in texts]
        out = [list(map(cache.get, some)) for some in cuts]
        gaps = [[k for k, e in enumerate(got) if e is None] for got in out]
        missing = {some[k] for some, at in zip(cuts, gaps) for k in at}
        if missing:
            short = [c for c in missing if len(c) <= SHORT]
            cache.update(zip(short, self.merger.merge(short)))
            long = {c: model.merged_ids(c) for c in missing if len(c) > SHORT}
            for some, got, at in zip(cuts, out, gaps):
                for k in at:
                    got[k] = cache.get(some[k]) or long[some[k]]
        return out

    def encode(self, sources: list[bytes]) -> list[tuple[list[tuple[tuple[int, ...], str]], list[int], np.ndarray]]:
        """Of each text its entries, its ids, and the source byte where each id ends."""
        model = self.model
        normal = [model.normalise(s) for s in sources]
        done = []
        for (_, starts), entries in zip(normal, self.entries([t for t, _ in normal])):
            ids = list(chain.from_iterable([e[0] for e in entries]))
            at = np.array(ids, dtype=np.int64)
            if starts is None:
                ends = np.cumsum(model.sizes[at])
                if model.dummy_prefix:
                    ends -= 1
            else:
                # a character spelled in bytes counts at its last byte
                chars = model.chars[at]
                chars[:-1][model.is_byte[at[:-1]] & model.inside[at[1:]]] = 0
                ends = np.asarray(starts, dtype=np.int64)[np.cumsum(chars)]
            done.append((entries, ids, ends))
        return done


def decode(model: Model, ids: list[int]) -> str:
    """The text of ids: byte pieces are joined before they are read as UTF-8, the leading mark goes."""
    kinds, raw = model.kinds, model.raw
    first = next((i for i in ids if kinds[i] != CONTROL), None)
    whole = b"".join(map(raw.__getitem__, ids))
    if (first is not None and kinds[first] == NORMAL and (model.dummy_prefix or model.squeeze)
            and whole.startswith(b" ")):
        whole = whole[1:]
    try:
        return whole.decode()
    except UnicodeDecodeError:
        return _decode_broken(model, ids)


def _decode_broken(model: Model, ids: list[int]) -> str:
    """As decode(), where a run of byte pieces is not UTF-8: each byte that fits nowhere is U+FFFD."""
    out: list[str] = []
    run = b""

    def flush(run: bytes) -> None:
        while run:
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[:size].decode())
                    run = run[size:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                run = run[1:]

    bare = model.dummy_prefix or model.squeeze
    for i in ids:
        if model.kinds[i] == BYTE:
            run += model.raw[i]
            continue
        flush(run)
        run = b""
        piece = model.raw[i].decode()
        if bare and model.kinds[i] == NORMAL and not any(out):
            piece, bare = (piece[1:], False) if piece.startswith(" ") else (piece, bare)
        out.append(piece)
    flush(run)
    return "".join(out)


def _mapped(docs: DataFrame, model_path: str, keep: list[str], text_col: str, fields: T.StructType,
            derive: Callable[[Model, list, list, np.ndarray], tuple]) -> DataFrame:
    blob = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def make():
        encoder = Encoder(Model(blob.value))
        return lambda sources: [derive(encoder.model, *found) for found in encoder.encode(sources)]

    return map_texts(docs, text_col, keep, fields, make, out_rows=128)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, ends``: the ids of each text; id k spans source bytes ends[k-1] (or 0) to ends[k]."""
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("ends", T.ArrayType(T.IntegerType(), False))])
    return _mapped(docs, model_path, [id_col], text_col, fields, lambda model, entries, ids, ends: (
        ids, ends.astype(np.int32)))


def decode_table(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of ids."""
    import pyarrow as pa
    blob = encoded.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def run(batches):
        model = Model(blob.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [decode(model, v.as_py() or []) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, T.StructType([source.schema[id_col], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """Digests of each text's ids, of the text decoded from those ids, and of the spans (little-endian ends)."""
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType()),
                           T.StructField("spans_sha256", T.StringType())])

    def derive(model: Model, entries: list, ids: list, ends: np.ndarray) -> tuple:
        text = ",".join([e[1] for e in entries])
        return (len(ids), hashlib.sha256(text.encode()).hexdigest(),
                hashlib.sha256(decode(model, ids).encode()).hexdigest(),
                hashlib.sha256(ends.astype("<i4").tobytes()).hexdigest())

    return _mapped(docs, model_path, keep or [id_col], text_col, fields, derive)
