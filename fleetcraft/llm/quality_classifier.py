"""Quality classifier: random-indexing word vectors, pooled per text, and a calibrated two-layer network.

A token is a run of word characters or another mark that is no white space. It
has a 64-bit hash, and so has its shape (runs of digits, capitals and other
letters; marks stand for themselves). Every different token has a sparse random
index vector of its own, drawn from its hash. The ``FREQUENT`` commonest tokens
of the corpus, counted exactly, have a context vector each; the rest share
``TAIL`` rows by hash, and shapes ``SHAPES`` rows. A context vector is the sum of
the index vectors, of token and shape, of the tokens next to it, over all
occurrences in all texts. Counts and sums are taken per task, then with one
grouped aggregate each; the finished table has ``SLOTS`` rows however large the
corpus is. Two tokens share a hash with a chance of 2^-64.

A text is the mean and the spread of its tokens' and its shapes' context
vectors. A two-layer network is fitted in numpy on a bounded sample of labelled
texts (see ``toxicity.labelled_sample``), weighted to the class shares of all
labels; a temperature fitted on held-back texts makes its softmax a probability.

Texts are cut into tokens by numpy over code points, many texts at a time, so
no token becomes a Python object.

Defined results: null or empty text has the zero vector; null labels and null
ids are not learnt from; without labels of both classes every score is the
share of class 1 (0.001 at least, 0.999 at most); repeated rows are all scored
and all counted; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import map_texts, store, utf8, worker_cache
from fleetcraft.llm.toxicity import labelled_sample

FREQUENT, TAIL, SHAPES, DIM = 1 << 15, 1 << 12, 1 << 10, 32
WORDS = FREQUENT + TAIL
SLOTS = WORDS + SHAPES
#: Entries of an index vector that are not 0 (where two fall together they add up): of a token's, of a shape's.
TOKEN_ENTRIES, SHAPE_ENTRIES = 4, 2
#: Labelled texts of each class that are learnt from, at most.
PER_CLASS = 4000
#: Tokens that a task adds up at a time, and code points that it cuts at a time.
CHUNK, PIECE = 1_000_000, 500_000
#: Tokens whose vectors are added up at a time.
TOGETHER = 1 << 14


def character_codes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its kind (0 white space, 1 word character, 2 other) and what stands for it in a shape."""
    kept = worker_cache("character-codes")
    if not kept:
        kind, form = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalnum():
                kind[code] = 1
                form[code] = ord("9") if c.isdigit() else ord("X") if c.isupper() else ord("x") if c.isalpha() else code
            elif c.isspace():
                kind[code] = 0
        kind[ord("_")] = 1
        kept["kind"], kept["form"] = kind, form
    return kept["kind"], kept["form"]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of codes from one start to the next: mixed sum of what each code at its place gives."""
    sizes = np.diff(np.append(starts, len(codes)))
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    each = _mixed((codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15))
    return _mixed(np.add.reduceat(each, starts) + sizes.astype(np.uint64))


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE characters, cut at white space (a longer stretch without any stays whole)."""
    at = 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shape hashes of all tokens of the texts, one text after the other, and the number of tokens of each."""
    kind, form = character_codes()
    hashes, shapes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    waiting, owners, length = [], [], 0

    def cut() -> None:
        points = np.frombuffer("\n".join(waiting).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = kind[points]
        at = np.flatnonzero(kinds)
        if not len(at):
            return
        kinds = kinds[at]
        joined = np.zeros(len(at), bool)
        joined[1:] = (kinds[1:] == 1) & (kinds[:-1] == 1) & (at[1:] == at[:-1] + 1)
        starts = np.flatnonzero(~joined)
        codes = points[at]
        hashes.append(_hashes(codes, starts))
        forms = form[codes]
        keep = ~joined
        keep[1:] |= forms[1:] != forms[:-1]
        shapes.append(_hashes(forms[keep], (np.cumsum(keep) - 1)[starts]))
        ends = np.cumsum([len(t) + 1 for t in waiting])
        np.add.at(sizes, np.array(owners), np.diff(np.append(0, np.searchsorted(at[starts], ends))))

    for k, text in enumerate(texts):
        for part in _pieces(text):
            waiting.append(part)
            owners.append(k)
            length += len(part)
            if length >= PIECE:
                cut()
                waiting, owners, length = [], [], 0
    if waiting:
        cut()
    return np.concatenate(hashes), np.concatenate(shapes), sizes


def _decoded(column) -> list[str]:
    return [v.decode("utf-8", "replace") for v in column.to_pylist()]


def _token_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """tokens() of the first column, of about CHUNK tokens at a time."""
    parts, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            parts.append(tokens(_decoded(batch.column(0).slice(start, rows))))
            n += len(parts[-1][0])
            if n >= CHUNK:
                yield tuple(np.concatenate(p) for p in zip(*parts))
                parts, n = [], 0
    if parts:
        yield tuple(np.concatenate(p) for p in zip(*parts))


def frequent_tokens(docs: DataFrame, text_col: str = "text", size: int = FREQUENT) -> np.ndarray:
    """Hashes of the ``size`` commonest tokens (of equals the lesser hash as a signed number), ascending as unsigned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _ in _token_batches(batches):
            found, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    counts = (docs.select(utf8(text_col).alias("text")).mapInArrow(run, "token long, n long")
              .groupBy("token").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "token").limit(size).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().astype(np.int64).view(np.uint64))


def slots_of(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The row of each token: its place in the vocabulary, or one of the shared rows after it."""
    tail = FREQUENT + (hashes % np.uint64(TAIL)).astype(np.int64)
    if not len(vocabulary):
        return tail
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, tail)


def index_entries(hashes: np.ndarray, shapes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The entries, and their signs, of the index vectors of tokens and of their shapes: six bits of the hash for each."""
    out = []
    for source, n in ((hashes, TOKEN_ENTRIES), (shapes, SHAPE_ENTRIES)):
        for k in range(n):
            bits = (source >> np.uint64(16 + 6 * k)).astype(np.int64) & 63
            out.append((bits >> 1, 1.0 - 2.0 * (bits & 1)))
    return out


def context_sums(hashes: np.ndarray, shapes: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Sums over the texts of the index vectors of each row's left and right neighbours."""
    word, form = slots_of(hashes, vocabulary) * DIM, (shapes % np.uint64(SHAPES)).astype(np.int64) * DIM
    words, forms = np.zeros(WORDS * DIM), np.zeros(SHAPES * DIM)
    if len(word) > 1:
        last = np.cumsum(sizes)[:-1]
        inside = np.ones(len(word) - 1)
        inside[last[(last > 0) & (last < len(word))] - 1] = 0
        for entry, sign in index_entries(hashes, shapes):
            for a, b in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
                weights = sign[b] * inside
                words += np.bincount(word[a] + entry[b], weights=weights, minlength=WORDS * DIM)
                forms += np.bincount(form[a] + entry[b], weights=weights, minlength=SHAPES * DIM)
    return np.concatenate([words, forms]).reshape(SLOTS, DIM)


@dataclass
class Table:
    """The vocabulary (hashes, ascending) and the context vectors: its rows, the shared ones, then those of shapes."""

    vocabulary: np.ndarray
    vectors: np.ndarray


def word_vectors(docs: DataFrame, text_col: str = "text") -> Table:
    """The context vectors over the whole corpus, centred and of length 1."""
    names = [f"c{k}" for k in range(DIM)]
    vocabulary = frequent_tokens(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, DIM))
        for part in _token_batches(batches):
            total += context_sums(*part, shared.value)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            rows = total[used].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(rows[:, k]) for k in range(DIM))],
                                             ["slot", *names])

    schema = "slot int, " + ", ".join(f"{c} long" for c in names)
    sums = (docs.select(utf8(text_col).alias("text")).mapInArrow(run, schema)
            .groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)))
    # SLOTS rows at most, whatever the corpus
    rows = store(sums, "context-sums").toArrow()
    table = np.zeros((SLOTS, DIM))
    at = rows.column("slot").to_numpy()
    if len(at):
        table[at] = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
        table = _unit(table)
    shared.unpersist()
    return Table(vocabulary, table)


def _unit(table: np.ndarray) -> np.ndarray:
    """Rows that are not 0, to length 1, less their mean, to length 1 again."""
    table = table.copy()
    seen = np.abs(table).sum(axis=1) > 0
    table[seen] /= np.linalg.norm(table[seen], axis=1, keepdims=True)
    table[seen] -= table[seen].mean(axis=0)
    table[seen] /= np.linalg.norm(table[seen], axis=1, keepdims=True) + 1e-9
    return table


def pooled(texts: list[str], table: Table) -> np.ndarray:
    """Mean and spread of the context vectors, for tokens and for shapes: 4 * DIM numbers per text."""
    out = np.zeros((len(texts), 4 * DIM), dtype=np.float32)
    hashes, shapes, sizes = tokens(texts)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full][:, None]
    starts = (np.cumsum(sizes) - sizes)[full]
    slots = slots_of(hashes, table.vocabulary)
    sums, squares = np.zeros((len(full), DIM)), np.zeros((len(full), DIM))
    for at in range(0, len(slots), TOGETHER):
        first = max(0, int(np.searchsorted(starts, at, side="right")) - 1)
        cuts = starts[first:np.searchsorted(starts, at + TOGETHER)] - at
        cuts[0] = max(0, cuts[0])
        vectors = table.vectors[slots[at:at + TOGETHER]]
        part = slice(first, first + len(cuts))
        sums[part] += np.add.reduceat(vectors, cuts, axis=0)
        squares[part] += np.add.reduceat(np.square(vectors, out=vectors), cuts, axis=0)
    owner = np.repeat(np.arange(len(full)), n[:, 0])
    counts = np.bincount(owner * SHAPES + (shapes % np.uint64(SHAPES)).astype(np.int64), minlength=len(full) * SHAPES)
    counts = counts.reshape(len(full), SHAPES).astype(np.float64)
    forms = table.vectors[WORDS:]
    for at, (total, square) in enumerate(((sums, squares), (counts @ forms, counts @ (forms * forms)))):
        mean = total / n
        out[full, 2 * at * DIM:(2 * at + 1) * DIM] = mean
        out[full, (2 * at + 1) * DIM:(2 * at + 2) * DIM] = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh units, two outputs, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Difference of the outputs before the temperature."""
        w1, b1, w2, b2 = self.weights
        z = np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2
        return z[:, 1] - z[:, 0]

    def chance(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.gap(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, labels: np.ndarray, prior: float, hidden: int = 32, epochs: int = 60, rate: float = 3e-3,
          decay: float = 1e-3, seed: int = 5) -> Network:
    """Minibatch Adam on weighted cross-entropy; every fifth text is held back for stopping and the temperature."""
    labels = np.asarray(labels, dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Network(np.zeros(1), np.ones(1), [], constant=float(np.clip(prior, 1e-3, 1 - 1e-3)))
    held = np.arange(len(labels)) % 5 == 4
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
              rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    inputs, onehot = (x - mean) / scale, np.eye(2)[labels]
    learn = np.flatnonzero(~held)
    best, best_loss, step = [p.copy() for p in params], np.inf, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            step += 1
            h = np.tanh(inputs[batch] @ params[0] + params[1])
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - onehot[batch]) * weight[batch][:, None] / len(batch)
            g_h = (g @ params[2].T) * (1 - h * h)
            grads = [inputs[batch].T @ g_h + decay * params[0], g_h.sum(axis=0), h.T @ g + decay * params[2],
                     g.sum(axis=0)]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        loss = _loss(Network(mean, scale, params).gap(x[held]), labels[held], weight[held], 1.0) if held.any() else -step
        if loss < best_loss:
            best, best_loss = [p.copy() for p in params], loss
    net = Network(mean, scale, best)
    if held.any():
        gap = net.gap(x[held])
        net.temperature = float(min(np.exp(np.linspace(-1.5, 1.5, 61)),
                                    key=lambda t: _loss(gap, labels[held], weight[held], t)))
    return net


def _loss(gap: np.ndarray, labels: np.ndarray, weight: np.ndarray, temperature: float) -> float:
    z = gap / temperature * np.where(labels == 1, 1, -1)
    return float((weight * np.logaddexp(0, -z)).mean())


def _vectors(docs: DataFrame, table: Table, keep: list[str], fields: T.StructType, derive,
             text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((table.vocabulary, table.vectors))

    def make():
        return lambda texts: derive(pooled([t.decode("utf-8", "replace") for t in texts], Table(*shared.value)))

    return map_texts(docs, text_col, keep, fields, make, out_rows=128)


def fit(docs: DataFrame, labels: DataFrame, table: Table, label_col: str = "quality",
        per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on a sample of ``labels`` rows (the caller chooses which rows may be learnt from)."""
    sample, prior = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    fields = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType()))])
    rows = _vectors(sample, table, ["doc_id", "label"], fields, lambda x: [(v,) for v in x])
    rows = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").toArrow()
    vectors = rows.column("vector").combine_chunks()
    x = np.asarray(vectors.flatten() if rows.num_rows else [], dtype=np.float64).reshape(-1, 4 * DIM)
    return train(x, rows.column("label").to_numpy(), prior)


def score(docs: DataFrame, table: Table, network: Network, keep: list[str], text_col: str = "text",
          name: str = "score") -> DataFrame:
    """``keep`` columns plus the probability of class 1."""
    parts = vars(network)

    def derive(x: np.ndarray) -> list[tuple]:
        net = Network(**parts)
        return [(float(p),) for p in net.chance(x.astype(np.float64))]

    return _vectors(docs, table, keep, T.StructType([T.StructField(name, T.DoubleType())]), derive, text_col)
