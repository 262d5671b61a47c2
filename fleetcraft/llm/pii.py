"""Personal data: pattern spans, and terms that give protected entities away.

Four patterns find emails, IP addresses, card and phone numbers. Each value
found is a protected entity, and so is the part of it that many share (an
email's domain, the first three numbers of an address, the first six digits of
the others), over which rare values are pooled. A text is read as consecutive
blocks of ``BLOCK`` words; a term t stands near an entity c if at most half as
many words lie between them. Over the different blocks of the corpus (entities
blanked out, so copies of a passage are one observation), N in number, n_c of
which hold c, n_t hold t and n_ct hold t near c, a term tells of c

    disclosure(c, t) = log(p N / n_c) / log(N / n_c),

the pointwise mutual information over the information content of c, where p is
the lower Wilson bound of n_ct / n_t at ``Z`` standard errors: a term that
appears only with c comes the closer to 1 the more often it was seen, and no
count of observations is required. A term is generalised where its disclosure
reaches ``GENERALISE`` and removed where it reaches ``REMOVE``, everywhere in
every text that holds the entity.

Entities and their neighbours are rare; only they are joined. The disclosure
falls with n_t, so a term too common in one block of ``SAMPLE`` (chosen by
content hash; its count there cannot exceed n_t) is known to be harmless. For
the others the corpus is read once more through a bit table that holds the
hashes of these terms: a row per block, its hash and such terms, is grouped by
hash, copies combining on the map side; other words never leave a task.

Defined results: null text is empty and has no spans; null ids keep their row;
rows with the same id and text are alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.llm.common import map_bytes, store, utf8

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE = KINDS[:4]
#: Words of a block, standard errors of the bound, and the two thresholds.
BLOCK, Z, GENERALISE, REMOVE = 20, 1.645, 0.8, 0.95
#: One block in so many gives the first, lower bound of a term's count.
SAMPLE = 16
#: Bits of the table of candidate terms: sixteen a term within these; a fuller table lets more words through, never fewer.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match starts where its run of digits does: from within the run it would go on alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TERM = re.compile(r"\w+")
_PIECE = re.compile(rf"[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++){{0,{BLOCK - 1}}}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Left to right by @: the run of allowed characters before it, a dotted name after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _EMAIL_LEFT.match(text[start - 1]):
            start -= 1
        right = _EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if right:
            yield start, right.end()
        done = right.end() if right else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind in code points; matches that fail their kind's check are dropped and not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def _hash(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _blank(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with its entities blanked out, positions unchanged."""
    for k in BASE:
        for a, b in spans.get(k, ()):
            text = text[:a] + " " * (b - a) + text[b:]
    return text


def terms_of(piece: str) -> set[str]:
    return set(_TERM.findall(piece.lower()))


def part_of(kind: str, value: str) -> str:
    """What an entity shares with others of its kind: a domain, a network, an issuer or an exchange."""
    if kind == "email":
        return value[value.index("@") + 1:].lower()
    if kind == "ip":
        return value[:value.rindex(".")]
    return "".join(c for c in value if c.isdigit())[:6]


def _near(text: str, blank: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """For each entity and its part, each block around it: is it the entity's own, and the terms near it there."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([w[0] for w in words])
    hashes: dict[int, int] = {}
    out = []
    for kind in BASE:
        for a, b in spans[kind]:
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, b, "left")) - 1
            low, high = max(first - BLOCK // 2, 0), min(last + BLOCK // 2 + 1, len(words))
            for k in range(low // BLOCK, (high - 1) // BLOCK + 1):
                here = words[k * BLOCK:(k + 1) * BLOCK]
                if k not in hashes:
                    hashes[k] = _hash(blank[here[0][0]:here[-1][1]])
                piece = blank[words[max(low, k * BLOCK)][0]:words[min(high, (k + 1) * BLOCK) - 1][1]]
                terms = sorted(terms_of(piece))
                for entity in (f"{kind}:{text[a:b]}", f"{kind} part:{part_of(kind, text[a:b])}"):
                    out.append({"entity": _hash(entity), "home": k == first // BLOCK, "block": hashes[k],
                                "terms": terms})
    return out


def describe(raw: bytes) -> tuple:
    """Counts and spans of one text, its blocks and those in the sample, what stands near its entities, its terms."""
    text = raw.decode("utf-8", "replace")
    spans = base_spans(text)
    held = any(spans.values())
    # entities are no terms: they are blanked everywhere
    blank = _blank(text, spans) if held else text
    n_blocks, sampled = 0, []
    for m in _PIECE.finditer(text):
        n_blocks += 1
        piece = blank[m.start():m.end()]
        if (block := _hash(piece)) % SAMPLE == 0:
            sampled.append({"block": block, "terms": sorted(terms_of(piece))})
    base = joined(spans)
    return (*(len(spans[k]) for k in BASE), base, hashlib.sha256(base.encode()).hexdigest(), n_blocks, sampled,
            _near(text, blank, spans) if held else [], sorted(terms_of(blank)) if held else [])


_TERMS = T.StructField("terms", T.ArrayType(T.StringType()))
#: What describe() returns.
FIELDS = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base", T.StringType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("n_blocks", T.LongType()),
    T.StructField("sampled", T.ArrayType(T.StructType([T.StructField("block", T.LongType()), _TERMS]))),
    T.StructField("near", T.ArrayType(T.StructType([
        T.StructField("entity", T.LongType()), T.StructField("home", T.BooleanType()),
        T.StructField("block", T.LongType()), _TERMS]))),
    _TERMS])


def _bit_table(terms: DataFrame) -> np.ndarray:
    """The hashes of terms as packed bits; the driver sees bits, a row for each 65,536 of them."""
    n_bits = LEAST_BITS
    wanted = 16 * terms.count()
    while n_bits < min(wanted, MOST_BITS):
        n_bits *= 2

    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sorted({_hash(t) % n_bits for t in batch.column(0).to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32())], ["bit"])

    bits = np.zeros(n_bits, dtype=bool)
    chunks = (terms.mapInArrow(bit, "bit int").groupBy(F.shiftright("bit", 16).alias("chunk"))
              .agg(F.collect_set(F.col("bit").bitwiseAND(0xFFFF)).alias("low")))
    for row in chunks.toLocalIterator():
        bits[(row["chunk"] << 16) + np.array(row["low"])] = True
    return np.packbits(bits, bitorder="little")


def _term_counts(docs: DataFrame, text_col: str, bits: np.ndarray) -> DataFrame:
    """``term, n_t``: different blocks that hold a term, for terms whose bit is set; all blocks hold the term ''."""
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        known: dict[str, bool] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found: dict[int, str] = {}
                for raw in batch.column(0).slice(start, 256):
                    text = raw.as_py().decode("utf-8", "replace")
                    blank = _blank(text, base_spans(text))
                    for m in _PIECE.finditer(text):
                        piece = blank[m.start():m.end()]
                        block = _hash(piece)
                        if block in found:
                            continue
                        words = terms_of(piece)
                        if len(known) > 300_000:
                            known.clear()
                        for w in words:
                            if w not in known:
                                at = _hash(w) % (8 * len(wanted))
                                known[w] = bool(wanted[at >> 3] >> (at & 7) & 1)
                        found[block] = " ".join(["", *sorted(w for w in words if known[w])])
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())],
                                                 ["block", "terms"])

    # terms are runs of word characters, so none holds a space
    blocks = (docs.select(utf8(text_col).alias("text")).mapInArrow(run, "block long, terms string")
              .groupBy("block").agg(F.first("terms").alias("terms")))
    return (blocks.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term")
            .agg(F.count("*").alias("n_t")))


def _disclosure(n: float, n_c, n_t, n_ct) -> F.Column:
    """The share of an entity's information that a term gives, from below."""
    p, zz = n_ct / n_t, Z * Z
    low = (p + zz / (2 * n_t) - Z * F.sqrt(p * (1 - p) / n_t + zz / (4 * n_t * n_t))) / (1 + zz / n_t)
    return F.when((n_c < n) & (low > 0), 1 + F.log(low) / F.log(F.lit(float(n)) / n_c)).otherwise(0.0)


def disclosures(described: DataFrame, docs: DataFrame, text_col: str = "text", least: float = GENERALISE) -> DataFrame:
    """``entity, term, n_c, n_t, n_ct, disclosure`` of every pair whose disclosure reaches ``least`` (above 0)."""
    near = described.select(F.explode("near").alias("x")).select("x.*")
    blocks = near.where("home").select("entity", "block").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = near.select("entity", "block", F.explode("terms").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_ct")).join(blocks, "entity")
    seen = (described.select(F.explode("sampled").alias("x")).select("x.*").groupBy("block")
            .agg(F.first("terms").alias("terms")).select(F.explode("terms").alias("term")).groupBy("term")
            .agg(F.count("*").alias("n_seen")))
    # copies included, the blocks are at least N: together with the least n_t this bounds the disclosure from above
    most = described.agg(F.sum("n_blocks")).first()[0] or 0
    bound = _disclosure(most, F.col("n_c"), F.greatest("n_ct", F.coalesce("n_seen", F.lit(0))), F.col("n_ct"))
    pairs = store(pairs.join(seen, "term", "left").where(bound >= least).drop("n_seen"), "disclosure-pairs")
    terms = pairs.select("term").distinct()
    if terms.isEmpty():
        return pairs.select("entity", "term", "n_c", F.lit(0).cast("long").alias("n_t"), "n_ct",
                            F.lit(0.0).alias("disclosure"))
    counts = store(_term_counts(docs, text_col, _bit_table(terms)), "term-counts")
    total = counts.where("term = ''").first()["n_t"]
    told = _disclosure(total, F.col("n_c"), F.col("n_t"), F.col("n_ct"))
    return (pairs.join(counts, "term").select("entity", "term", "n_c", "n_t", "n_ct", told.alias("disclosure"))
            .where(F.col("disclosure") >= least))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE,
                  remove: float = REMOVE) -> DataFrame:
    """``doc_id, text_hash, n_email, n_ip, n_card, n_phone, base, base_sha256, spans`` per document."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(utf8(text_col)).alias("text_hash"))
    described = store(map_bytes(keyed, "text", ["doc_id", "text_hash"], FIELDS, lambda: describe), "personal")
    told = disclosures(described, docs, text_col, generalise).select(
        "entity", "term", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))
    told = store(told, "disclosing-terms")
    # a term tells of few entities (it is seldom seen without them), so texts meet them by their terms first
    held = described.where(F.size("near") > 0)
    met = held.select("doc_id", "text_hash", F.explode("terms").alias("term")).join(told, "term")
    owns = held.select("doc_id", "text_hash", F.explode("near.entity").alias("entity")).distinct()
    alike = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
             & (F.col("a.entity") == F.col("b.entity")))
    marked = (met.alias("a").join(owns.alias("b"), alike, "left_semi")
              .groupBy("doc_id", "text_hash", "term")
              .agg(F.max("action").alias("action")).groupBy("doc_id", "text_hash")
              .agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("marked")))
    marked = store(marked, "marked-terms")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    added = (keyed.alias("a").join(marked.alias("b"), same).select("a.doc_id", "a.text_hash", "a.text", "b.marked"))
    added = added.mapInArrow(_add_terms, T.StructType([added.schema["doc_id"], added.schema["text_hash"],
                                                       T.StructField("spans", T.StringType())])).distinct()
    return described.alias("a").join(added.alias("b"), same, "left").select(
        "a.doc_id", "a.text_hash", *(f"n_{k}" for k in BASE), "base", "base_sha256",
        F.coalesce("spans", "base").alias("spans"))


def term_spans(text: str, spans: dict[str, list[tuple[int, int]]], marked: dict[str, str]) -> dict:
    """The base spans and those of every marked term outside them."""
    out = {k: list(v) for k, v in spans.items()}
    for m in _TERM.finditer(_blank(text, spans)):
        if (action := marked.get(m[0].lower())) is not None:
            out.setdefault(action, []).append(m.span())
    return out


def _add_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            spans = [joined(term_spans(t, base_spans(t), dict(m)))
                     for t, m in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.string())],
                                             ["doc_id", "text_hash", "spans"])


def sanitise(text: str, spans: str) -> str:
    """The text with its spans replaced: entities by their kind, terms by their shape or by nothing."""
    parts = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    out, at = [], 0
    for a, b, kind in sorted(parts):
        if a < at:
            continue
        piece = "".join("0" if c.isdigit() else "x" for c in text[a:b]) if kind == "generalise" else \
            "" if kind == "remove" else f"[{kind}]"
        out += [text[at:a], piece]
        at = b
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """All columns of the documents with personal data replaced in the text."""
    spans = find_personal(docs, id_col, text_col, **thresholds).where("spans <> ''").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).distinct()
    met = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(utf8(text_col)) == F.col("__hash")),
                    "left").select(*docs.columns, "__spans")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                columns = part.columns[:-1]
                columns[at] = pa.array([t if t is None or not s else sanitise(t, s) for t, s in zip(
                    part.column(at).to_pylist(), part.column(len(columns)).to_pylist())], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    return met.mapInArrow(run, docs.schema)
