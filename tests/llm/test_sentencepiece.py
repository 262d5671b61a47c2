import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library

from fleetcraft.llm import sentencepiece as sp
from tests.llm.helpers import awkward_docs, docs_frame, empty_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return sp.Model(f.read())


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    alphabet = list("abc  the\n\t▁é漢😀.,'0123<s>Σ​́") + ["the", " of", "ing", "⁇", "<unk>"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(n)] + [
        "", " ", "▁", "\n", "a" * 300, " " * 50 + "x", "  lead", "trail  "]


def test_ids_text_and_spans_equal_the_library(model):
    lib = library.SentencePieceProcessor(model_file=PATH)
    texts = fuzz(400)
    for text, (_, ids, ends) in zip(texts, sp.Encoder(model).encode([t.encode() for t in texts])):
        want = lib.encode(text)
        assert ids == want
        assert sp.decode(model, ids) == lib.decode(want)
        assert list(ends) == sorted(ends) and (not ids or ends[-1] == len(text.encode()))
        pieces = lib.encode(text, return_type="proto").pieces
        assert all(int(e) == p.end for e, p in zip(ends, pieces) if not model.is_byte[p.id])


def test_decoding_any_ids_equals_the_library(model):
    lib = library.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(4)
    for _ in range(400):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(32000), 261, 1, 2, 0]) for _ in range(rnd.randint(0, 10))]
        assert sp.decode(model, ids) == lib.decode(ids)


def test_long_cuts_merge_as_short_ones_do(model):
    rnd = random.Random(5)
    for _ in range(100):
        parts = [rnd.choice("thearn") for _ in range(rnd.randint(2, 60))]
        assert model._merge_long(list(parts)) == model.merge("".join(parts))


def normalised_model(rule):
    """The model file with another library rule's compiled character map and white-space handling."""
    with open(PATH, "rb") as f:
        blob = f.read()
    spec = library.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    charsmap = dict(sp._fields(dict(sp._fields(spec))[3]))[2]

    def field(number, payload):
        size, out = len(payload), b""
        while True:
            out += bytes([size & 127 | (128 if size > 127 else 0)])
            size >>= 7
            if not size:
                return bytes([number << 3 | 2]) + out + payload

    normaliser = field(1, rule.encode()) + field(2, charsmap) + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1])
    return blob + field(3, normaliser)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_maps_equal_the_library(rule):
    try:
        blob = normalised_model(rule)
        lib = library.SentencePieceProcessor(model_proto=blob)
    except Exception as e:
        pytest.skip(f"the library gives no map of its own: {e}")
    model = sp.Model(blob)
    assert model.charmap is not None
    texts = fuzz(200, 7) + ["ﬁne ＡＢＣ １２３　x", "ａ́ ｶﾞ ㍿ ½ ²", "  Two  Spaces  "]
    for text, (_, ids, ends) in zip(texts, sp.Encoder(model).encode([t.encode() for t in texts])):
        proto = lib.encode(text, return_type="proto")
        assert ids == [p.id for p in proto.pieces], text
        assert all(int(e) == p.end for e, p in zip(ends, proto.pieces) if not model.is_byte[p.id]), text


def test_trie_finds_the_longest_key():
    """A hand-made double array with the keys a -> x and ab -> yz."""
    units = [0] * 512
    base = 256

    def unit(label, offset, leaf):
        return label | offset << 10 | (1 << 8 if leaf else 0)

    units[0] = unit(0, base, False)
    a = base ^ ord("a")
    units[a] = unit(ord("a"), 128, True)
    after_a = a ^ 128
    units[after_a] = 1 << 31 | 0
    b = after_a ^ ord("b")
    units[b] = unit(ord("b"), 1, True)
    units[b ^ 1] = 1 << 31 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    charmap = sp.CharMap(blob)
    assert charmap.longest(b"abc", 0) == (b"yz", 2)
    assert charmap.longest(b"ac", 0) == (b"x", 1)
    assert charmap.longest(b"c", 0) is None


def test_awkward_rows(spark):
    lib = library.SentencePieceProcessor(model_file=PATH)
    rows = awkward_docs()
    got = sp.encode(docs_frame(spark), PATH)
    want = sorted(((r[0], lib.encode(r[1] or "")) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=str) == want
    back = sp.decode_table(got, PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == \
        sorted(((r[0], lib.decode(lib.encode(r[1] or ""))) for r in rows), key=str)
    assert sp.round_trip(empty_docs(spark), PATH).count() == 0
    assert np.array_equal([r["n_tokens"] for r in sp.round_trip(docs_frame(spark), PATH).where("doc_id = 4").collect()], [0])
