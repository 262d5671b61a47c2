"""Whitening against numpy's eigenvectors, exact whole numbers and awkward tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from fleetcraft.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("x", T.StringType()), T.StructField("n", T.StringType())])


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "clash", "clash") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors, m=8):
    """Rows, n, deviations, eigenvalues and projections by numpy, from the vectors that stay."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    xs = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n = len(xs)
    sums = [sum(col) for col in zip(*xs)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    x = np.array(xs, float)
    d = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, deviations, values[:m], values.sum(), d @ axes[:, :m] / np.sqrt(values[:m])


def samples(n, width, seed, spread=None):
    rng = np.random.default_rng(seed)
    scale = spread if spread is not None else rng.uniform(0.05, 0.4, width)
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    return [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(n, width)) * scale @ turn)]


def check(got, vectors, m):
    kept, deviations, values, trace, whitened = plain(vectors, m)
    assert len(got) == len(kept) * m
    by = {}
    for r in got:
        assert r["n"] == len(kept) and r["identity_error"] < 1e-8
        assert abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-12
        by.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], r["whitened"]))
    for c in range(m):
        ids = sorted({i for i, _ in kept}, key=lambda i: (i is None, i))
        flat = [(d, w) for i in ids for d, w in sorted(by[i, c + 1])]
        want = [(d, w) for i in ids for d, w in sorted((deviations[k], whitened[k, c]) for k in range(len(kept)) if kept[k][0] == i)]
        minus = [(d, w) for i in ids for d, w in sorted((deviations[k], -whitened[k, c]) for k in range(len(kept)) if kept[k][0] == i)]
        assert [d for d, _ in flat] == [d for d, _ in want]
        errors = [max(abs(a[1] - b[1]) for a, b in zip(flat, other)) for other in (want, minus)]
        assert min(errors) < 1e-8, (c, errors)


def test_matches_numpy_with_awkward_rows(spark):
    vectors = samples(400, 24, 3)
    vectors += [(i, v) for i, v in vectors[:50]] * 4  # repeated rows
    vectors += [(None, v) for _, v in vectors[60:70]]
    vectors += [(900, None), (901, [None] * 24), (902, [0.1] * 23 + [None]), (903, [float("nan")] * 24),
                (904, [float("inf")] + [0.0] * 23), (None, None)]
    random.Random(1).shuffle(vectors)
    check(whitening.whiten(frame(spark, vectors), 8).collect(), vectors, 8)


def test_partitioning_changes_no_more_than_rounding(spark):
    vectors = samples(300, 20, 4)
    runs = [sorted((r["vec_id"], r["component"], r["whitened"]) for r in whitening.whiten(frame(spark, vectors, p), 4).collect())
            for p in (1, 7)]
    for a, b in zip(*runs):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8


def test_other_widths_and_huge_entries_are_dropped(spark):
    vectors = samples(60, 10, 5)
    odd = [(800, [0.5] * 9), (801, []), (802, [1e30] * 10), (803, [0.5] * 11)]
    check(whitening.whiten(frame(spark, vectors + odd), 3).collect(), vectors, 3)


def test_fewer_dimensions_than_components(spark):
    vectors = samples(60, 3, 6)
    got = whitening.whiten(frame(spark, vectors), 8).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    check(got, vectors, 3)


def test_directions_without_variance_are_no_components(spark):
    flat = [(i, [v[0], v[1], 0.25, 0.25, 0.25]) for i, v in samples(80, 2, 7)]
    got = whitening.whiten(frame(spark, flat), 4).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [0.5, 0.5])], [(i, [0.5, 0.1]) for i in range(9)], [(1, []), (2, [])]):
        assert whitening.whiten(frame(spark, vectors), 8).count() == 0


def test_deviation_beyond_64_bits_is_null_and_exact_in_decimals(spark):
    vectors = [(i, [float(i % 7) * 2 ** 20, float(i % 3)]) for i in range(50)]
    got = {(r["vec_id"], r["deviation"], int(r["deviation_decimal"])) for r in whitening.whiten(frame(spark, vectors), 2).collect()}
    kept, deviations, *_ = plain(vectors, 2)
    assert got == {(i, d if d < 2 ** 63 else None, d) for (i, _), d in zip(kept, deviations)}
    assert any(d is None for _, d, _ in got)


@pytest.mark.parametrize("values", [np.ones(40), np.linspace(1, 1.01, 80), np.array([1e6, 1.0, 0.999] + [0.5] * 60),
                                    np.r_[np.ones(9), np.zeros(50)], np.logspace(0, -9, 64), np.ones(2)])
def test_iteration_is_certified_on_hard_spectra(values):
    width = len(values)
    turn = np.linalg.qr(np.random.default_rng(8).normal(size=(width, width)))[0]
    matrix = turn * values @ turn.T
    found, axes, residuals = whitening.components_of(lambda q: matrix @ q, width, 8)
    want = np.sort(values)[::-1][:8]
    assert np.abs(found - want).max() <= 1e-11 * want[0]
    assert residuals.max() <= whitening.CERTIFIED * want[0]
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-12


def test_wrong_products_are_not_certified():
    rng = np.random.default_rng(1)
    with pytest.raises(ArithmeticError):
        whitening.components_of(lambda q: rng.normal(size=(30, q.shape[1])), 30, 4)
