import random

import numpy as np
import pytest
import xxhash

from fleetcraft.llm import simhash
from fleetcraft.llm.graph import components
from tests.llm.helpers import awkward_docs, docs_frame, empty_docs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        r = root(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f, least.get(root(k))) for k, (i, f) in enumerate(fps)), key=str)


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            gap = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, radius)))
            assert any(gap & m == 0 for m in masks)


def test_awkward_rows_match_brute_force(spark):
    got = simhash.near_duplicates(docs_frame(spark)).collect()
    want = plain_components([(r[0], r[1]) for r in awkward_docs()])
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_in_crowded_buckets_match_brute_force(spark, chunk):
    """Dense neighbourhoods, searched whole and as pairs of small chunks."""
    rnd = random.Random(2)
    fps = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = {r["node"]: r["root"] for r in
             components(simhash.links(spark.createDataFrame(signed, "fp long"), 3, chunk)).collect()}
    got = [roots.get(s[0], s[0]) for s in signed]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    same = lambda labels: {(a, b) for a in range(len(fps)) for b in range(a) if labels[a] == labels[b]}
    assert same(got) == same([root(k) for k in range(len(fps))])


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {k: 0 for k in range(1, 61)} | {101: 100}


def test_empty_table(spark):
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_reach_links_what_is_close():
    edges = simhash.reach(np.array([0, 1, 0xFF, 0xFF << 32], dtype=np.uint64), 3)
    assert edges == [(0, 1)]
