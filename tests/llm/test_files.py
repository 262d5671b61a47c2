"""Token shards and WARC archives: exact round trips."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetcraft.llm import token_shards, warc
from fleetcraft.llm.mph import PerfectHash
from tests.llm.helpers import awkward_docs, docs_frame, empty_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_perfect_hash_numbers_keys_without_gaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(-2 ** 62, 2 ** 62, n))
        table = PerfectHash.build(keys)
        assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(-2 ** 62, 2 ** 62, 2000), keys)
        assert (table.find(others) >= 0).mean() < 0.01


def test_cached_encoding_equals_the_library():
    with open(PATH, "rb") as f:
        encoder = token_shards.WordEncoder(f.read())
    rnd = random.Random(3)
    parts = list("abcAB  \n\t'sré.,!?#<|>09ΣÁİ́  \x1c") + ["<|startoftext|>", "<|STARTOFTEXT|>", "it's", "don't.", "!!"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, raw, e in zip(texts, encoder.encode([t.encode() for t in texts]), want):
        assert np.frombuffer(raw, encoder.dtype).tolist() == e.ids, text


def test_shards_give_back_every_document(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = awkward_docs()
    manifest = token_shards.write_shards(docs_frame(spark), PATH, shard_ids=300)
    assert manifest.count() > 3
    ids = {(r[0], r[1] or ""): tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    got = [(r["doc_id"], r["start"], list(r["ids"])) for r in token_shards.read_ids(manifest).collect()]
    assert sorted(((i, x) for i, _, x in got), key=str) == \
        sorted(((r[0], ids[r[0], r[1] or ""]) for r in rows), key=str)
    at = 0
    order = sorted(got, key=lambda g: g[1])
    for i, start, x in order:
        assert start == at
        at += len(x)
    assert [i for i, _, _ in order] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    digests = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_shards.read_digests(manifest).collect()}
    assert digests == {(i, s): (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in got}
    found = sorted((r["doc_id"], list(r["ids"])) for r in token_shards.lookup(manifest, [2, 9, 105, 777, -1]).collect())
    assert found == sorted((i, x) for i, _, x in got if i in (2, 9, 105))


def test_no_documents_no_shards(spark):
    manifest = token_shards.write_shards(empty_docs(spark), PATH)
    assert manifest.count() == 0 and token_shards.read_digests(manifest).count() == 0


def pages():
    rnd = random.Random(5)
    big = "<p>" + "x é漢 " * 60 + "</p>"
    rows = [(k, f"http://h/{k}", rnd.choice([big, big + "2", "short", "<a>" * rnd.randint(1, 4000)])) for k in range(120)]
    return rows + [(200, None, None), (201, "http://a b\r\nX: y", ""), (None, "u", big), (7, "again", big), (7, "twice", big),
                   (202, "u", "".join(chr(rnd.randrange(32, 0x2000)) for _ in range(30_000)))]


def plain_pages(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        of = first.get(html or "")
        again = len(raw) >= 100 and of is not None and i != of
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=str)


def test_archives_give_back_every_page_at_any_split(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS salt")
    manifest = warc.write_archives(df, archive_bytes=4000)
    assert manifest.count() > 2
    for split in (50, 700, 1 << 20):
        got = sorted((tuple(r) for r in warc.read_digests(manifest, split).collect()), key=str)
        assert got == plain_pages(rows), split
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_pages(manifest).where("payload is not null").collect()}
    assert payloads[202] == rows[-1][2].encode() and payloads[200] == b""


def test_ranges_split_records_exactly_once_and_skip_false_magic():
    members = []
    for k in range(40):
        body = warc.record(k, "u", "0" * 64, 3 + k, b"a" * 3 + bytes(range(k)), None)
        packer = zlib.compressobj(0 if k % 3 == 0 else 6, zlib.DEFLATED, 31)
        members.append(packer.compress(body) + packer.flush())
    members.insert(20, b"\x1f\x8b\x08junk between records\x1f\x8b\x08")
    blob = b"".join(members)

    class File:
        @staticmethod
        def read_at(n, at):
            return blob[at:at + n]

    for step in (1, 17, 100, 10_000):
        found = [head["warc-record-id"] for start in range(0, len(blob), step)
                 for head, _ in warc.records_of_range(File, len(blob), start, start + step)]
        assert found == [f"<{warc._URN}{k}>" for k in range(40)]
    assert io.BytesIO(blob).read(3) == warc.MAGIC


def test_no_pages_no_archive(spark):
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and warc.read_digests(manifest).count() == 0


def test_pages_with_long_urls_are_read_back(spark):
    rnd = random.Random(8)
    rows = [(k, "http://h/?" + "".join(rnd.choices("abcdefghij0123456789%&=", k=n)), f"<p>{k}</p>")
            for k, n in enumerate((10, 70_000, 200_000, 20, 2_000_000, 30))]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for split in (5000, 1 << 20):
        assert sorted((tuple(r) for r in warc.read_digests(manifest, split).collect()), key=str) == plain_pages(rows), split


def test_missing_records_are_an_error(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(5)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert warc.read_pages(manifest).count() == 5
    with pytest.raises(ValueError, match="records read"):
        warc.read_digests(manifest.selectExpr("path", "n_bytes", "n_records + 1 AS n_records")).count()


def test_a_key_is_compared_beyond_its_fingerprint(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string").coalesce(1)
    path = token_shards.write_shards(docs, PATH).first()["path"]
    shard = token_shards.Shard(path)
    monkeypatch.setattr(type(shard.table), "find", lambda self, keys: np.zeros(len(keys), np.int64))
    answered = [k for k in range(-5, 40) if shard.get(k)]
    assert len(answered) == 1 and 0 <= answered[0] < 20
