"""Toxicity, quality classifier and quality rules: held-out accuracy and brute force."""

import random
import re
from collections import Counter

import numpy as np

from fleetcraft.llm import quality_classifier, quality_rules, subword, toxicity
from tests.llm.helpers import DOCS, awkward_docs, docs_frame, empty_docs, prose

SF = "/root/testdata/sf0.01"


def test_subwords_hash_alike_alone_and_together():
    words = ["a", "word", "wording", "été", "x" * 40]
    rows, owner = subword.subwords(words, 1 << 19)
    for k, w in enumerate(words):
        alone, _ = subword.subwords([w], 1 << 19)
        assert sorted(rows[owner == k].tolist()) == sorted(alone.tolist())
    assert ((0 <= rows) & (rows < 1 << 19)).all()


def labelled(n, seed=1):
    rnd = random.Random(seed)
    bad = ["dreadful", "horrid", "vile"]
    rows, labels = [], []
    for k in range(n):
        words = prose(rnd, rnd.randint(20, 120))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((k, " ".join(words), "en", "a", 1))
        labels.append((k, int(toxic), int(not toxic)))
    return rows, labels


def test_toxicity_holds_on_unseen_texts_and_misspellings(spark):
    rows, labels = labelled(500)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int, quality int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    right = [(got[k] >= 0.5) == bool(t) for k, t, _ in labels[400:]]
    assert sum(right) / len(right) > 0.95
    clean = model.word_scores([f"w{k}" for k in range(200)])
    assert model.word_scores(["dreadfull"])[0] > clean.mean() + 3 * clean.std()


def test_toxicity_of_awkward_rows(spark):
    rows, labels = labelled(60)
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, known)
    out = toxicity.score(docs_frame(spark, extra=False), model, ["doc_id"]).collect()
    assert len(out) == len(awkward_docs()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty_docs(spark), model, ["doc_id"]).count() == 0
    none = toxicity.fit(empty_docs(spark), known.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_quality_classifier_on_the_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = quality_classifier.word_vectors(docs)
    network = quality_classifier.fit(docs, labels.where("doc_id % 4 <> 1"), table)
    got = (quality_classifier.score(docs, table, network, ["doc_id"]).join(labels.where("doc_id % 4 = 1"), "doc_id").collect())
    right = [(r["score"] >= 0.7) == bool(r["quality"]) for r in got]
    assert sum(right) / len(right) > 0.93
    assert 0.0 < network.temperature < 10


TOKEN = re.compile(r"\w+|[^\w\s]")


def plain_shape(token):
    forms = ["9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token]
    return "".join(c for k, c in enumerate(forms) if k == 0 or c != forms[k - 1])


def texts_for_tokens():
    rnd = random.Random(8)
    parts = ["The", "the", "a1", "A1b2", "_x", "__", "é", "漢字", "😀", "\x00", "’", "...", " ", "\n", "\u3000", "x" * 30, "IX", "٣", "²", "Ǆ", "\x1c"]
    made = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    return [*made, "", " ", "one", "a" * 3000, "end.\n", "."]


def test_tokens_and_shapes_match_regular_expression(monkeypatch):
    texts = texts_for_tokens()
    want = [TOKEN.findall(t) for t in texts]
    for piece in (quality_classifier.PIECE, 7):
        monkeypatch.setattr(quality_classifier, "PIECE", piece)
        hashes, shapes, sizes = quality_classifier.tokens(texts)
        assert sizes.tolist() == [len(w) for w in want]
        flat = [t for w in want for t in w]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
        forms = [plain_shape(t) for t in flat]
        assert len(set(zip(forms, shapes.tolist()))) == len(set(forms)) == len(set(shapes.tolist()))


def test_frequent_tokens_are_counted_over_all_texts(spark):
    texts = ["a b a c", "b a", None, "c c c c d", "a e", ""]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], DOCS).repartition(4)
    one = lambda t: int(quality_classifier.tokens([t])[0][0])
    assert set(quality_classifier.frequent_tokens(docs, size=3).tolist()) == {one("a"), one("b"), one("c")}


def plain_vectors(texts, vocabulary):
    """Context sums by loops over neighbours; rows named by place in the table."""
    q = quality_classifier
    table = np.zeros((q.SLOTS, q.DIM))
    place = {int(h): k for k, h in enumerate(vocabulary)}
    for text in texts:
        hashes, shapes, _ = q.tokens([text])
        rows = [(place.get(int(h), q.FREQUENT + int(h) % q.TAIL), q.WORDS + int(f) % q.SHAPES) for h, f in zip(hashes, shapes)]
        for i, mine in enumerate(rows):
            for j in (i - 1, i + 1):
                if 0 <= j < len(rows):
                    for source, n in ((int(hashes[j]), q.TOKEN_ENTRIES), (int(shapes[j]), q.SHAPE_ENTRIES)):
                        for k in range(n):
                            bits = source >> (16 + 6 * k) & 63
                            for row in mine:
                                table[row, bits >> 1] += 1 - 2 * (bits & 1)
    return table


def test_context_sums_match_a_plain_count():
    texts = ["The cat, the CAT!", "", "one", "a b", *texts_for_tokens()[:60]]
    hashes, shapes, sizes = quality_classifier.tokens(texts)
    vocabulary = np.unique(hashes)[::2]
    got = quality_classifier.context_sums(hashes, shapes, sizes, vocabulary)
    assert np.array_equal(got, plain_vectors(texts, vocabulary))
    alone = [quality_classifier.context_sums(*quality_classifier.tokens([t]), vocabulary) for t in texts]
    assert np.array_equal(sum(alone), got)


def plain_pooled(text, table):
    q = quality_classifier
    hashes, shapes, _ = q.tokens([text])
    place = {int(h): k for k, h in enumerate(table.vocabulary)}
    out = []
    for rows in ([place.get(int(h), q.FREQUENT + int(h) % q.TAIL) for h in hashes], [q.WORDS + int(f) % q.SHAPES for f in shapes]):
        vectors = table.vectors[rows]
        out += [vectors.mean(axis=0), vectors.std(axis=0)] if rows else [np.zeros(q.DIM)] * 2
    return np.concatenate(out)


def test_pooled_vectors_and_scores_match_a_plain_version(spark, monkeypatch):
    q = quality_classifier
    texts = [*texts_for_tokens(), "w " * 5000]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    table = q.word_vectors(docs)
    sums = plain_vectors(texts, table.vocabulary)
    assert np.allclose(table.vectors, q._unit(sums), atol=1e-6)
    want = np.stack([plain_pooled(t, table) for t in texts])
    for together in (q.TOGETHER, 5):
        monkeypatch.setattr(q, "TOGETHER", together)
        assert np.allclose(q.pooled(texts, table), want, atol=1e-6)
    rng = np.random.default_rng(3)
    net = q.Network(rng.normal(size=128), rng.uniform(0.5, 2, 128),
                    [rng.normal(size=(128, 8)), rng.normal(size=8), rng.normal(size=(8, 2)), rng.normal(size=2)], 1.7)
    got = {r["doc_id"]: r["score"] for r in q.score(docs, table, net, ["doc_id"]).collect()}
    w1, b1, w2, b2 = net.weights
    for k, x in enumerate(want):
        z = np.tanh((x - net.mean) / net.scale @ w1 + b1) @ w2 + b2
        p = np.exp(z / 1.7) / np.exp(z / 1.7).sum()
        assert abs(got[k] - p[1]) < 1e-4


def test_network_gradient_lowers_the_loss_it_states():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    labels = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality_classifier.train(x, labels, 0.5, epochs=150)
    assert ((net.chance(x) >= 0.5) == labels).mean() > 0.9
    held = np.arange(600) % 5 == 4
    losses = {t: quality_classifier._loss(net.gap(x[held]), labels[held], np.ones(held.sum()), t)
              for t in (net.temperature, net.temperature * 1.2, net.temperature / 1.2)}
    assert min(losses, key=losses.get) == net.temperature


def test_quality_classifier_of_awkward_rows(spark):
    docs = docs_frame(spark)
    table = quality_classifier.word_vectors(docs)
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 120)] + [(None, 1)], "doc_id long, quality int")
    network = quality_classifier.fit(docs, labels, table)
    out = quality_classifier.score(docs_frame(spark, extra=False), table, network, ["doc_id"]).collect()
    assert len(out) == len(awkward_docs()) and all(0 <= r["score"] <= 1 for r in out)
    none = quality_classifier.word_vectors(empty_docs(spark))
    assert not none.vectors.any() and not len(none.vocabulary)
    assert quality_classifier.fit(empty_docs(spark), labels.limit(0), none).constant == 0.5


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    count, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(k, k + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(cover))


def test_counts_match_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        words = [rnd.choice(["a", "b", "ç#", "|", "$x"]) + rnd.choice([" ", "\n", "\t ", "  "]) for _ in range(rnd.randint(0, 60))]
        text = "".join(words)
        assert quality_rules.count_text(text.encode())[:5] == plain_counts(text)


FLOORS = np.array(list(quality_rules.FLOORS.values()))


def floored(cov):
    return cov + np.diag(np.maximum(0, FLOORS ** 2 - np.diag(cov)) + 1e-3 * FLOORS ** 2)


def octave(d2):
    return np.floor(np.log2(d2 + 2.0 ** -20) * quality_rules.OCTAVE)


def rank(values, share):
    return np.sort(values)[max(0, int(np.ceil(share * len(values))) - 1)]


def plain_mcd(x, steps=quality_rules.STEPS):
    """Mean and covariance after concentration steps, all in numpy."""
    mean = np.array([rank(c, 0.5) for c in x.T])
    cov = np.diag(np.maximum([(rank(c, 0.75) - rank(c, 0.25)) / 1.349 for c in x.T], FLOORS) ** 2)
    for _ in range(steps):
        code = octave(np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(floored(cov)), x - mean))
        y = x[code <= rank(code, quality_rules.SHARE)]
        mean, cov = y.mean(axis=0), np.cov(y.T, bias=True)
    return mean, cov


def plain_distances(x, lang, source):
    """Robust distances with estimates drawn from group to language to table."""
    k = quality_rules.PRIOR
    draw = lambda own, n, wide: tuple((n * a + k * b) / (n + k) for a, b in zip(own, wide))
    whole = plain_mcd(x)
    d2, factor_of = np.zeros(len(x)), {}
    for g in set(lang):
        of_lang = lang == g
        wide = draw(plain_mcd(x[of_lang]), of_lang.sum(), whole)
        for h in set(source[of_lang]):
            mine = of_lang & (source == h)
            mean, cov = draw(plain_mcd(x[mine]), mine.sum(), wide)
            d2[mine] = np.einsum("ni,ij,nj->n", x[mine] - mean, np.linalg.inv(floored(cov)), x[mine] - mean)
    middle = lambda some: max(1.0, 2 ** ((rank(octave(d2[some]), 0.5) + 0.5) / quality_rules.OCTAVE) / quality_rules.chi_square(7, 0.0))
    out = np.zeros(len(x))
    for g in set(lang):
        of_lang = lang == g
        for h in set(source[of_lang]):
            mine = of_lang & (source == h)
            n = mine.sum()
            out[mine] = d2[mine] / ((n * middle(mine) + k * middle(of_lang)) / (n + k))
    return out


def rule_corpus():
    rnd = random.Random(4)
    rows = []
    for k in range(400):
        words = prose(rnd, rnd.randint(25, 90))
        if k % 40 == 3:
            words = [w.upper() + "###" for w in words]
        rows.append((k, " ".join(words), "en" if k < 380 else "de", f"s{k % 2}" if k < 350 else "small", 1))
    return rows


def test_distances_match_a_plain_estimate_however_rows_are_dealt(spark):
    rows = rule_corpus()
    runs = [{r["doc_id"]: (r["distance"], r["kept"]) for r in quality_rules.judge(spark.createDataFrame(rows, DOCS).repartition(n)).collect()}
            for n in (2, 7)]
    assert runs[0] == runs[1]
    junk = {k for k in range(400) if k % 40 == 3}
    assert {k for k, (_, kept) in runs[0].items() if not kept} == junk
    counts = quality_rules.text_counts(spark.createDataFrame(rows, DOCS), ["doc_id", "lang", "source"])
    vectors = {r["doc_id"]: [r[c] for c in quality_rules.NAMES] for r in quality_rules._groups(quality_rules._vector(counts)).collect()}
    want = plain_distances(np.array([vectors[k] for k in range(400)]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    assert np.allclose([runs[0][k][0] for k in range(400)], want, rtol=1e-6)


def test_more_steps_change_no_verdict_and_one_text_groups_are_judged(spark):
    rows = rule_corpus() + [(900, " ".join(prose(random.Random(1), 60)), "fr", "alone", 1), (901, "### $$$ " * 30 + "x y z " * 5, "en", "odd", 1)]
    verdicts = [{r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOCS), steps=n).collect()}
                for n in (quality_rules.STEPS, 12)]
    assert verdicts[0] == verdicts[1] and verdicts[0][900] and not verdicts[0][901]


def test_rules_of_awkward_rows(spark):
    out = quality_rules.judge(docs_frame(spark)).collect()
    assert len(out) == len(awkward_docs())
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[4]["base_failed"] and not by_id[4]["kept"] and by_id[110]["kept"]
    assert quality_rules.judge(empty_docs(spark)).count() == 0
