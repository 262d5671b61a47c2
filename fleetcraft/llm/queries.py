"""The registered queries of the subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcraft.llm import (decontaminate, fill_in_middle, line_dedup, pii, quality_classifier, quality_rules, sentencepiece, simhash,
                            token_shards, toxicity, url_filter, warc, whitening)
from fleetcraft.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents", ["doc_id", "text"]), shingle=3, radius=3)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                            "n_repeat_words", "base_failed", "kept")


@query("op8_token_output")
def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(load(spark, sf_dir, "documents", ["doc_id", "text"]),
                                         public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_shards.read_digests(manifest)


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return sentencepiece.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


def fold(column: str, of: int):
    """Remainder of the crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = load(spark, sf_dir, "labels", ["doc_id", "toxic"]).where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_line_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
    c AS (SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l),
    n AS (SELECT doc_id, ln, w, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line,
                 row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k,
                 sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM c WHERE w > 0),
    p AS (SELECT a.doc_id, a.k AS s, b.k AS e FROM n a JOIN n b
          ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.w >= 50),
    win AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s
            UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
    t AS (SELECT win.doc_id, s, e, string_agg(line, chr(10) ORDER BY k) AS run
          FROM win JOIN n ON n.doc_id = win.doc_id AND n.k BETWEEN s AND e GROUP BY win.doc_id, s, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM t),
    gone AS (SELECT DISTINCT n.doc_id, n.ln FROM r JOIN n ON n.doc_id = r.doc_id AND n.k BETWEEN r.s AND r.e
             WHERE r.nth > 1),
    x AS (SELECT c.doc_id, count(*) FILTER (c.w > 0) AS n_lines, count(gone.ln) AS n_removed,
                 string_agg(c.line, chr(10) ORDER BY c.ln) FILTER (gone.ln IS NULL) AS rest
          FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND gone.ln = c.ln GROUP BY c.doc_id)
    SELECT doc_id, n_lines, n_removed,
           CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE rest END AS text FROM x""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents", ["doc_id", "text"])).select(
        "doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(load(spark, sf_dir, "documents", ["doc_id", "text"]),
                                  load(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query("op10_warc", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
               FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM g""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_digests(warc.write_archives(load(spark, sf_dir, "pages", ["page_id", "url", "html"])))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(load(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = load(spark, sf_dir, "labels", ["doc_id", "quality"]).where(fold("doc_id", 4) != 2)
    table = quality_classifier.word_vectors(docs)
    scored = quality_classifier.score(docs, table, quality_classifier.fit(docs, labels, table), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op13_fill_in_middle", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                 ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
                 ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
                 greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
                      THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT doc_id, n, form, t, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid,
                 array_to_string(w[b + 1:n], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.fill_in_middle(load(spark, sf_dir, "documents", ["doc_id", "text"]))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restore().cast("binary"), 256).alias("restored_sha256"))


@query("op12_url_filter")
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(load(spark, sf_dir, "pages", ["page_id", "url"]), url_filter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), components=8)
