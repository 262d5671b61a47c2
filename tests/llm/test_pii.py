import math
import random
import re

from fleetcraft.llm import pii
from tests.llm.helpers import DOCS, awkward_docs, docs_frame, empty_docs

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = lambda pattern, ok: [m.span() for m in re.finditer(pattern, text) if ok(m)]
    return {"email": spans(EMAIL, lambda m: True),
            "ip": spans(IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
            "card": spans(CARD, lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
            "phone": spans(PHONE, lambda m: 8 <= len(digits(m)) <= 15)}


def test_base_spans_match_the_patterns():
    rnd = random.Random(5)
    parts = list("aB9.@+-( )_%0123\n,é") + ["a@b.c", "1.2.3.4", "+1 (234) 555-6789", "4111 1111 1111 1111", "x@y.z-"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for c in ("a", "1", "1 ", "+1", "a@", "1.", "+1 ("):
        pii.base_spans(c * 60_000)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def planted():
    """A nickname stands near one address only, a rare one near an address seen twice; common words everywhere."""
    rnd = random.Random(7)
    fill = [f"f{k}" for k in range(300)]
    rows = []
    for k in range(600):
        words = [rnd.choice(fill) for _ in range(40)]
        if k % 10 == 0:
            words[5:5] = ["Zorro,", "common", "ann@home.example.org", "half"]
        elif k in (111, 222):
            # the block's edge lies between the name and the address
            words[19:21] = ["Quixote", "Bo@rare.example.net"]
        elif k % 3 == 0:
            words[3] = "common"
        if k % 40 == 1:
            words[30] = "half"
        if k == 20:
            words.append("zorro")
        rows.append((k, " ".join(words), "en", "a", 1))
    return rows


def keys_of(kind, value):
    part = value.split("@")[1].lower() if kind == "email" else value.rpartition(".")[0] if kind == "ip" else \
        re.sub("[^0-9]", "", value)[:6]
    return f"{kind}:{value}", f"{kind} part:{part}"


def plain_disclosures(rows, least):
    """Counts over every different block, word by word."""
    holds, near, own, every = {}, {}, {}, set()
    for _, text, *_ in rows:
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        spans = plain_base(text or "")
        blank = list(text or "")
        for found in spans.values():
            for a, b in found:
                blank[a:b] = " " * (b - a)
        blank = "".join(blank)
        block = [blank[words[k // 20 * 20][0]:words[min(k // 20 * 20 + 19, len(words) - 1)][1]] for k in range(len(words))]
        every.update(block)
        terms = [re.findall(r"\w+", blank[a:b].lower()) for a, b in words]
        for k, found in enumerate(terms):
            for t in found:
                holds.setdefault(t, set()).add(block[k])
        for kind, found in spans.items():
            for a, b in found:
                inside = [k for k, w in enumerate(words) if w[0] < b and w[1] > a]
                for key in keys_of(kind, text[a:b]):
                    own.setdefault(key, set()).add(block[inside[0]])
                    for k in range(max(inside[0] - 10, 0), min(inside[-1] + 11, len(words))):
                        for t in terms[k]:
                            near.setdefault((key, t), set()).add(block[k])
    out = {}
    for (key, t), blocks in near.items():
        n, p, z, n_c = len(holds[t]), len(blocks) / len(holds[t]), 1.645, len(own[key])
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        value = 1 + math.log(low) / math.log(len(every) / n_c) if len(every) > n_c else 0.0
        if value >= least:
            out[pii._hash(key), t] = (n_c, n, len(blocks), value)
    return out


def found_disclosures(docs, least):
    described = pii.store(pii.map_bytes(docs.select("text"), "text", [], pii.FIELDS, lambda: pii.describe), "test")
    return {(r["entity"], r["term"]): (r["n_c"], r["n_t"], r["n_ct"], r["disclosure"])
            for r in pii.disclosures(described, docs, least=least).collect()}


def same_disclosures(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-9 for k in want)


def test_terms_that_give_an_entity_away_are_found(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS)
    for least in (0.2, pii.GENERALISE):
        same_disclosures(found_disclosures(docs, least), plain_disclosures(rows, least))
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs).collect()}
    text = rows[20][1]
    # marked wherever the text holds it, also in a block without the address
    for at in (text.index("Zorro"), text.index("zorro")):
        assert "remove:%d:%d" % (at, at + 5) in spans[20]
    assert "email:" in spans[20] and spans[1] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "zorro" not in clean[20].lower() and "[email]" in clean[20] and clean[1] == rows[1][1]
    assert "common" in clean[20]


def test_a_pair_seen_twice_is_found_across_a_block_edge(spark):
    rows = planted()
    got = pii.find_personal(spark.createDataFrame(rows, DOCS)).where("doc_id in (111, 222)").collect()
    for r in got:
        text = rows[r["doc_id"]][1]
        at = text.index("Quixote")
        assert f"generalise:{at}:{at + 7}" in r["spans"]
        # nothing else in these texts is marked: the other words stand in many blocks
        assert r["spans"].count(":") == 4


def test_rare_values_are_pooled_over_their_part(spark):
    """Every address is seen once, their domain often: its nickname is told by the domain."""
    rnd = random.Random(17)
    fill = [f"f{k}" for k in range(100)]
    rows = []
    for k in range(1000):
        words = rnd.choices(fill, k=20)
        if k < 40:
            words[4:6] = ["Acme", f"u{k}@acme.example.org"]
        rows.append((k, " ".join(words), "en", "a", 1))
    docs = spark.createDataFrame(rows, DOCS)
    want = plain_disclosures(rows, 0.5)
    same_disclosures(found_disclosures(docs, 0.5), want)
    assert want[pii._hash("email part:acme.example.org"), "acme"][3] > 0.95
    assert all("remove:" in r["spans"] for r in pii.find_personal(docs).where("doc_id < 40").collect())
    # nothing but the addresses and the name: precision 1
    assert all(r["spans"].count(":") == (4 if r["doc_id"] < 40 else 0) for r in pii.find_personal(docs).collect())


def test_random_texts_match_brute_force(spark):
    rnd = random.Random(23)
    parts = [f"w{k}" for k in range(60)] + ["a@b.c", "a@c.d", "x@b.c", "1.2.3.4", "1.2.3.9", "+1 (234) 555-6789",
                                            "4111 1111 1111 1111", "é", "名", "A.b"]
    rows = [(k, "".join(rnd.choice(parts) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randint(0, 90))), "en", "a", 1)
            for k in range(80)] + [(None, None, None, None, None), (1, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows * 2, DOCS).repartition(5)
    for least in (0.05, 0.5):
        same_disclosures(found_disclosures(docs, least), plain_disclosures(rows, least))


def test_copies_of_one_passage_are_one_observation(spark):
    rows = [(k, "call Bartholomew at bart@home.example.org " + "now then " * 6, "en", "a", 1) for k in range(30)]
    rows += [(100 + k, f"other words {k}", "en", "a", 1) for k in range(30)]
    assert all("remove" not in r["spans"] and "generalise" not in r["spans"]
               for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect())


def test_awkward_rows(spark):
    got = pii.find_personal(docs_frame(spark))
    assert got.count() == len(awkward_docs())
    assert {r["spans"] for r in got.collect()} == {""}
    assert pii.find_personal(empty_docs(spark)).count() == 0
    assert pii.sanitised(docs_frame(spark)).count() == len(awkward_docs())


def test_copied_passages_do_not_dilute_a_disclosing_term(spark):
    rnd = random.Random(11)
    fill = [f"f{k}" for k in range(300)]
    texts = [" ".join(["Zorro", "ann@home.example.org", *rnd.choices(fill, k=18)]) for _ in range(3)] * 100
    texts += [" ".join(rnd.choices(fill, k=20)) for _ in range(700)] + ["", None]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = found_disclosures(docs, 0.5)
    same_disclosures(got, plain_disclosures(rows, 0.5))
    assert got[pii._hash("email:ann@home.example.org"), "zorro"][:3] == (3, 3, 3)
    assert all("generalise:0:5" in r["spans"] for r in pii.find_personal(docs).where("doc_id < 300").collect())


def test_pieces_are_blocks_of_words():
    rnd = random.Random(13)
    for _ in range(2000):
        text = "".join(rnd.choice(["a", "b1", " ", "\n", "\t\x0b", "é", "\xa0", "\x1c", "x y z "]) for _ in range(rnd.randint(0, 150)))
        words = [m.span() for m in pii._WORD.finditer(text)]
        want = [(words[k][0], words[min(k + pii.BLOCK, len(words)) - 1][1]) for k in range(0, len(words), pii.BLOCK)]
        assert [m.span() for m in pii._PIECE.finditer(text)] == want
