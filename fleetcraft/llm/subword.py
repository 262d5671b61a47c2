"""Subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the mean of the vectors of its character n-grams (with word-boundary
marks) and of the word itself, all hashed into one table; a text is the mean of
its words; a softmax layer gives the classes. Table and layer are trained
together, so a misspelling never seen shares most of its vectors with the word
it stems from.

The layer is linear, so a trained model folds into one number per table row,
and a text's logit is the mean of its words' numbers plus a constant: scoring
needs no vectors.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

NGRAMS = (3, 4, 5)
#: Averages are stretched so before the layer: a text is told by a few of its words.
GAIN = 50.0
_WORD = r"\w+"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of all words, and the index of each one's word (words joined, hashed by column)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    left = ends[owner] - np.arange(len(codes))
    prime, spread = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    rows, owners = [], []
    h = np.full(len(codes), 0xCBF29CE484222325, dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = (h ^ np.concatenate([codes[n - 1:], np.zeros(min(n - 1, len(codes)), np.uint32)])[:len(codes)]) * prime
        if n in NGRAMS:
            fits = left >= n
            rows.append(((h[fits] ^ np.uint64(n)) * spread) >> shift)
            owners.append(owner[fits])
    # the whole word: a position-weighted sum of its characters
    starts = ends - sizes
    place = (np.arange(len(codes)) - starts[owner]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.add.reduceat((codes.astype(np.uint64) + np.uint64(977)) * (place * spread) if len(codes) else codes,
                            starts) if len(words) else np.empty(0, np.uint64)
    rows.append(((whole ^ (whole >> np.uint64(29))) * spread) >> shift)
    owners.append(np.arange(len(words)))
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


@dataclass
class Folded:
    """A trained model folded to one number per table row."""

    table: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        rows, owner = subwords(words, len(self.table))
        return (np.bincount(owner, weights=self.table[rows], minlength=len(words))
                / np.bincount(owner, minlength=len(words)))


class Scorer:
    """Scores texts with a bounded cache of word scores; one per task."""

    def __init__(self, model: Folded, cache: int = 200_000):
        self.model, self.limit, self.cache = model, cache, {}

    def logits(self, texts: list[str]) -> list[float]:
        """A logit per text; a text without words has the constant alone."""
        cache = self.cache
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in cache})
        if len(cache) + len(new) > self.limit:
            cache.clear()
            new = list({w for words in split for w in words})
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            cache.update(zip(some, self.model.word_scores(some).tolist()))
        return [sum(map(cache.__getitem__, w)) / len(w) + self.model.bias if w else self.model.bias for w in split]


def count_words(text: str) -> tuple[list[str], list[int]]:
    c = Counter(words_of(text))
    return list(c), list(c.values())


def _descend(value_and_slope, x: np.ndarray, steps: int, seen, memory: int = 5) -> None:
    """Limited-memory quasi-Newton descent with halving line search; ``seen`` gets every accepted point."""
    value, slope = value_and_slope(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, kept = slope.copy(), []
        for move, change, rho in reversed(moves):
            a = rho * float(move @ q)
            q -= a * change
            kept.append(a)
        if moves:
            move, change, rho = moves[-1]
            q *= 1.0 / (rho * float(change @ change))
        else:
            q *= 1.0 / (np.linalg.norm(q) + 1e-12)
        for (move, change, rho), a in zip(moves, reversed(kept)):
            q += (a - rho * float(change @ q)) * move
        gain, size = float(q @ slope), 1.0
        if gain <= 0:
            return
        for _ in range(12):
            new = x - size * q
            new_value, new_slope = value_and_slope(new)
            if new_value <= value - 1e-4 * size * gain:
                break
            size /= 2
        else:
            return
        move, change = new - x, new_slope - slope
        if (curve := float(move @ change)) > 1e-12:
            moves = [*moves[-memory + 1:], (move, change, 1.0 / curve)]
        x, value, slope = new, new_value, new_slope
        if seen(x):
            return


def train(words: list[str], word_at: np.ndarray, doc_at: np.ndarray, counts: np.ndarray, labels: np.ndarray,
          prior: float, buckets: int = 1 << 19, dim: int = 2, steps: int = 80, decay: float = 1e-3,
          patience: int = 25, least: int = 5, power: float = -0.25, seed: int = 7) -> Folded:
    """Fit on word counts: text ``doc_at[k]`` holds ``words[word_at[k]]`` ``counts[k]`` times, each pair once.

    ``prior`` is class 1's share among all labelled texts, sampled or not. Table
    and layer descend together on the whole sample; every tenth text is held
    back to choose the best step.
    """
    labels = np.asarray(labels, dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(prior, 1e-3, 1 - 1e-3))
        return Folded(np.zeros(buckets), float(np.log(share / (1 - share))))
    weight = counts / np.bincount(doc_at, weights=counts, minlength=len(labels))[doc_at]
    texts = np.bincount(word_at, minlength=len(words))
    known = np.flatnonzero(texts >= least)
    if not len(known):
        known = np.arange(len(words))
    place = np.full(len(words), -1)
    place[known] = np.arange(len(known))
    kept = place[word_at] >= 0
    word_at, doc_at, weight = place[word_at[kept]], doc_at[kept], weight[kept]
    index, texts = [words[k] for k in known], texts[known]
    rows, owner = subwords(index, buckets)
    used, rows = np.unique(rows, return_inverse=True)
    share = 1.0 / np.bincount(owner, minlength=len(index))
    n_docs, n_words, n_rows = len(labels), len(index), len(used)
    # rows of many texts move a little less: they would else drown those of tens
    spread = np.bincount(rows, weights=texts.astype(float)[owner], minlength=n_rows)
    spread = ((spread / least) ** power)[:, None]
    held = np.arange(n_docs) % 10 == 9
    onehot = np.eye(2)[labels]
    rng = np.random.default_rng(seed)
    cut = n_rows * dim
    start = np.concatenate([1e-3 * rng.uniform(-1, 1, cut), rng.uniform(-1, 1, 2 * dim), np.zeros(2)])

    def pool(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[:cut].reshape(n_rows, dim), x[cut:cut + 2 * dim].reshape(dim, 2), x[cut + 2 * dim:]

    def chances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, layer, bias = parts(x)
        words = pool((table * spread)[rows], owner, n_words) * share[:, None]
        docs = GAIN * pool(words[word_at] * weight[:, None], doc_at, n_docs)
        z = docs @ layer + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return docs, p / p.sum(axis=1, keepdims=True)

    last: dict[str, np.ndarray] = {}

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        table, layer, _ = parts(x)
        docs, p = chances(x)
        last["p"] = p
        n = (~held).sum()
        value = -np.log(p[~held, labels[~held]] + 1e-12).sum() / n + decay / 2 * float(x[:-2] @ x[:-2])
        g = (p - onehot) / n
        g[held] = 0
        g_docs = GAIN * (g @ layer.T)
        g_words = pool(g_docs[doc_at] * weight[:, None], word_at, n_words) * share[:, None]
        g_table = pool(g_words[owner], rows, n_rows) * spread + decay * table
        return value, np.concatenate([g_table.ravel(), (docs.T @ g + decay * layer).ravel(), g.sum(axis=0)])

    best = {"x": start, "loss": np.inf, "age": 0}

    def seen(x: np.ndarray) -> bool:
        loss = float(-np.log(last["p"][held, labels[held]] + 1e-9).mean()) if held.any() else -1.0
        best["age"] += 1
        if loss < best["loss"]:
            best.update(x=x, loss=loss, age=0)
        return best["age"] >= patience

    _descend(value_and_slope, start, steps, seen)
    small, layer, bias = parts(best["x"])
    table = np.zeros(buckets)
    table[used] = GAIN * (small * spread) @ (layer[:, 1] - layer[:, 0])
    _, p = chances(best["x"])
    logits = np.log(p[:, 1] + 1e-12) - np.log(p[:, 0] + 1e-12)
    slope, shift = _calibrate(logits[held], labels[held], prior, labels[~held].mean())
    return Folded(table * slope, float((bias[1] - bias[0]) * slope + shift))


def _calibrate(logits: np.ndarray, labels: np.ndarray, prior: float, share: float) -> tuple[float, float]:
    """Slope and constant that make held-back logits probabilities under the prior (Newton, 20 steps).

    With fewer than ten held-back texts of either class only the prior is
    corrected for.
    """
    prior, share = np.clip([prior, share], 1e-3, 1 - 1e-3)
    slope, shift = 1.0, float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    if min((labels == 0).sum(), (labels == 1).sum()) < 10:
        return slope, shift
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    theta = np.array([slope, shift])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - labels)) + 0.5 * (theta - [slope, shift])
        theta = theta - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), grad)
    return float(max(theta[0], 0.1)), float(theta[1])
