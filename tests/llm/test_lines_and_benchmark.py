import itertools
import math
import random
import re

import numpy as np
import pytest

from fleetcraft.llm import decontaminate, line_dedup
from tests.llm.helpers import DOCS, awkward_docs, docs_frame, empty_docs, prose


def plain_dedup(rows, least=50):
    """Every window of consecutive lines with ``least`` words or more; all but the first copy of each goes."""
    order = sorted({(-1 if i is None else i, line_dedup.xxhash.xxh64_intdigest((t or "").encode()), t or "")
                    for i, t in rows}, key=lambda x: x[0])
    first, runs = {}, []
    for i, _, text in order:
        lines = [(k, x.strip(" \t\n\r\v\f")) for k, x in enumerate(text.split("\n"))]
        lines = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in lines if x]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][2]
                if n >= least:
                    key = tuple(x for _, x, _ in lines[a:b + 1])
                    place = (i, a)
                    runs.append((i, text, key, place, [k for k, _, _ in lines[a:b + 1]]))
                    first[key] = min(first.get(key, place), place)
    gone = {}
    for i, text, key, place, lines in runs:
        if place > first[key]:
            gone.setdefault((i, text), set()).update(lines)
    return gone


def corpus():
    rnd = random.Random(9)
    shared = [" ".join(prose(rnd, n)) for n in (55, 10, 30, 25, 5, 60)]
    rows = []
    for k in range(40):
        lines = [" ".join(prose(rnd, rnd.randint(1, 30))) for _ in range(rnd.randint(1, 8))]
        at = rnd.randint(0, len(lines))
        a = rnd.randint(0, 4)
        lines[at:at] = shared[a:rnd.randint(a + 1, 6)]
        if k % 7 == 0:
            lines += ["", "  "] + lines[:3]
        rows.append((k, "\n".join(lines)))
    return rows


def test_deleted_lines_match_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = plain_dedup(rows)
    assert gone
    for i, text in rows:
        lines, lost = text.split("\n"), gone.get((i, text), set())
        wordy = [k for k, x in enumerate(lines) if x.strip()]
        rest = "\n".join(x for k, x in enumerate(lines) if k not in lost) if len(lost) < len(wordy) else ""
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) == (rest, len(wordy), len(lost)), i


def test_equal_runs_always_share_a_fingerprint():
    rnd = random.Random(4)
    run = "\n".join(" ".join(prose(rnd, n)) for n in (20, 20, 20))
    for _ in range(50):
        texts = ["\n".join([" ".join(prose(rnd, rnd.randint(1, 80))), run, " ".join(prose(rnd, 9))]) for _ in range(2)]
        a, b = ({(fp, d) for fp, d, _, _ in line_dedup.windows(t.encode())} for t in texts)
        assert a & b


def test_awkward_rows(spark):
    docs = docs_frame(spark)
    out = line_dedup.dedup_lines(docs)
    rows = {(r["doc_id"], r["n_removed"] > 0, r["text"]) for r in out.collect()}
    assert out.count() == len(awkward_docs())
    copy = next(r[1] for r in awkward_docs() if r[0] == 1)
    # the null id counts as smallest and keeps the copy; texts under it that repeat it are emptied, repeated rows alike
    assert (None, False, copy) in rows and (1, True, "") in rows and (2, True, "") in rows
    assert (3, False, None) in rows and (4, False, "") in rows and (7, False, "  \n\t\n ") in rows
    assert set(docs.columns) - {"n_removed"} <= set(out.columns)
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_a_passage_of_a_third_of_all_rows(spark):
    rnd = random.Random(6)
    passage = " ".join(prose(rnd, 60))
    rows = [(k, f"{' '.join(prose(rnd, 10))}\n{passage}" if k % 3 == 0 else " ".join(prose(rnd, 70)), "en", "a", 1)
            for k in range(300)]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert [k for k, n in out.items() if n] and all((n == 1) == (k % 3 == 0 and k > 0) for k, n in out.items())


def test_a_run_is_found_whose_fingerprint_line_occurs_earlier_elsewhere(spark):
    rnd = random.Random(7)
    lines = [" ".join(prose(rnd, 20)) for _ in range(4)]
    other = lambda: " ".join(prose(rnd, 30))
    for line in lines:
        rows = [(1, "\n".join([other(), line, other()])), (2, "\n".join([other(), *lines, other()])),
                (3, "\n".join([other(), line, other()])), (4, "\n".join([*lines, other()]))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
        assert got == {1: 0, 2: 0, 3: 0, 4: 4}


BENCH = "item_id long, text string"


def holds(equal, least):
    """Whether some stretch has ``least`` equal positions and is equal in four of five."""
    return any(sum(equal[a:b]) >= least and 5 * sum(equal[a:b]) >= 4 * (b - a)
               for a in range(len(equal)) for b in range(a + 1, len(equal) + 1))


def meets_mask(equal, item_tokens):
    """Whether some mask's window lies on equal positions (or the whole of an item shorter than a mask)."""
    if item_tokens < max(map(len, decontaminate.MASKS)) and len(equal) == item_tokens and all(equal):
        return True
    return any(all(equal[at + k] for k, c in enumerate(mask) if c == "1")
               for mask in decontaminate.MASKS for at in range(len(equal) - len(mask) + 1))


def plain_overlaps(docs, items, least=decontaminate.LEAST):
    """The stated check on every alignment of every text and item that some mask meets."""
    out = set()
    for i, text in docs:
        d = np.array(decontaminate.tokens_of(text or ""), dtype=object)
        for j, item in items:
            b = np.array(decontaminate.tokens_of(item or ""), dtype=object)
            if len(b) < decontaminate.SHORTEST:
                if len(b) and d.tolist() == b.tolist():
                    out.add((i, j))
                continue
            need = min(least, len(b))
            for at in range(-len(b) + 1, len(d)):
                low, high = max(0, -at), min(len(b), len(d) - at)
                equal = (d[at + low:at + high] == b[low:high]).tolist()
                if sum(equal) >= need and meets_mask(equal, len(b)) and holds(equal, need):
                    out.add((i, j))
    return out


@pytest.mark.parametrize("block", [300_000, 40])
def test_overlaps_match_brute_force(spark, block):
    rnd = random.Random(8)
    items = [(j, " ".join(prose(rnd, n, 3000))) for j, n in enumerate((9, 12, 13, 20, 40, 60, 5))] + [(50, None), (51, "")]
    items.append((52, items[4][1]))
    docs = []
    for k in range(60):
        words = prose(rnd, rnd.randint(0, 60), 3000)
        if k % 2:
            piece = rnd.choice(items[:7])[1].split()
            if k % 4 == 1 and len(piece) > 15:
                for _ in range(len(piece) // 10):
                    piece[rnd.randrange(len(piece))] = "swapped"
            at = rnd.randint(0, len(words))
            words[at:at] = piece
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else ", ".join(words)))
    docs += [(None, items[5][1]), (70, None), (71, ""), (72, items[6][1].upper() + "!"), (73, items[6][1] + " more")]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, BENCH), block_tokens=block)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == plain_overlaps(docs, items)


def test_benchmark_edge_cases(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], BENCH)
    none = spark.createDataFrame([], BENCH)
    assert decontaminate.overlaps(docs_frame(spark), none).count() == 0
    assert decontaminate.overlaps(empty_docs(spark), bench).count() == 0
    assert decontaminate.overlaps(docs_frame(spark), bench).count() == 0


@pytest.mark.parametrize("size", [13, 14, 15, 16, 17, 18, 19, 20, 22, 25, 30, 40, 59])
def test_recall_of_every_accepted_number_of_substitutions(size):
    rnd = random.Random(size)
    words = [f"b{k}" for k in range(size)]
    index = decontaminate.Index([(1, words)])
    for swaps in range(min(size - decontaminate.LEAST, size // 5) + 1):
        every = list(itertools.combinations(range(size), swaps)) if math.comb(size, swaps) <= 1200 else \
            [rnd.sample(range(size), swaps) for _ in range(1200)]
        texts = [["x", *(f"s{k}" if k in set(gone) else w for k, w in enumerate(words)), "y"] for gone in every]
        found = index.search(texts, decontaminate.LEAST)
        assert len(found) >= 0.9 * len(texts), (size, swaps, len(found) / len(texts))
        assert swaps > 1 or len(found) == len(texts)


def test_any_stretch_that_meets_the_check_is_accepted():
    rnd = random.Random(12)
    for size in (9, 13, 15, 16, 17, 20, 24, 40):
        words = [f"b{k}" for k in range(size)]
        index = decontaminate.Index([(1, words)])
        for _ in range(300):
            swapped = set(rnd.sample(range(size), rnd.randint(0, size // 3)))
            text = ["x"] * 3 + [f"s{k}" if k in swapped else w for k, w in enumerate(words)] + ["y"] * rnd.randint(0, 9)
            equal = [k not in swapped for k in range(size)]
            ids = np.array([index.vocabulary.get(t, 0) for t in text])
            found = index.verify(ids, 0, 3, decontaminate.LEAST)
            least = min(decontaminate.LEAST, size)
            assert (found is not None) == holds(equal, least), (size, swapped)
            if found:
                start, n_aligned, n_equal = found
                assert equal[start - 3] and equal[start - 4 + n_aligned]
                assert n_equal == sum(equal[start - 3:start - 3 + n_aligned]) >= least and 5 * n_equal >= 4 * n_aligned
                assert not holds(equal, n_equal + 1)


def test_a_substitution_near_the_end_of_a_short_item_is_found(spark):
    words = [f"b{k}" for k in range(16)]
    docs = [(k, " ".join(w if j != k else "swapped" for j, w in enumerate(words))) for k in range(16)]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame([(1, " ".join(words))], BENCH)).collect()
    assert {r["doc_id"]: r["n_equal"] for r in found} == {k: 15 for k in range(16)}
