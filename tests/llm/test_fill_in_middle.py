"""Fill-in-the-middle: cuts, forms and restored texts against a plain version over regular expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetcraft.llm import fill_in_middle as fim
from tests.llm.helpers import awkward_docs, docs_frame, empty_docs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, plain_percent=50, spm_percent=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "bc", " ", "\n", "\t\t", "é", "漢字", "😀", "\x00", "<", "<P", "S>", " ", "\x1c", "word " * 30]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [*made, "<P>", "x <M> y", "a<S>b", "", "   ", "\n", "x", " x ", "<<S", "é" * 5000, " " * 5000, "ab " * 9000]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 512])
def test_cuts_match_regular_expression(block):
    for text in texts(150):
        index = fim.UnitIndex(text.encode(), block)
        units = UNIT.findall(text)
        assert index.n_units == len(units)
        ks = range(len(units) + 1) if len(units) < 200 else (0, 1, len(units) // 3, len(units) - 1, len(units))
        for k in ks:
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head)), (text, k, block)


def test_fenwick_sums():
    counts = fim.np.array([3, 0, 5, 1, 1, 2, 7])
    assert fim.fenwick(counts) == [0, 3, 3, 5, 9, 1, 3, 7]
    assert fim.fenwick(counts[:0]) == [0]


@pytest.mark.parametrize("percents", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_rows_match_plain_version(spark, percents):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts(300, 5))] + awkward_docs()
    done = fim.fill_in_middle(docs_frame(spark, rows), plain_percent=percents[0], spm_percent=percents[1])
    got = done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string"),
                      fim.restore().alias("restored")).collect()
    want = [(r[0], *plain(r[0], r[1], 42, *percents), r[1] or "") for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark):
    done = fim.fill_in_middle(empty_docs(spark))
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and done.count() == 0
