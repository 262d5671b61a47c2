"""The pipeline stage by stage against plain versions of what each must do."""

import corpus_pipeline
from fleetcraft.llm.queries import ORACLES, QUERIES
from fleetcraft.llm import line_dedup
from tests.llm.helpers import DOCS, awkward_docs, docs_frame, empty_docs
from tests.llm.test_lines_and_benchmark import plain_dedup, plain_overlaps
from tests.llm.test_simhash import plain_components

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_every_stage_does_its_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    now = stages["toxicity"](spark, docs, SF).cache()
    assert now.columns == docs.columns
    kept = {r["doc_id"] for r in now.collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) / len(clean) > 0.95

    before = sorted((r["doc_id"], r["text"]) for r in now.collect())
    gone = plain_dedup(before)
    want = set()
    for i, text in before:
        lost = gone.get((i, text), set())
        if not lost:
            want.add((i, text))
        elif len(lost) < sum(bool(x.strip()) for x in text.split("\n")):
            want.add((i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost)))
    now = stages["line_dedup"](spark, now, SF).cache()
    assert as_rows(now) == want and now.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())

    want = {(i, t) for i, t in as_rows(now) if (i, i) in {(a, c) for a, _, c in plain_components(sorted(as_rows(now)))}}
    now = stages["simhash"](spark, now, SF).cache()
    assert as_rows(now) == want and now.columns == docs.columns

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _ in plain_overlaps(sorted(as_rows(now)), items)}
    want = {(i, t) for i, t in as_rows(now) if i not in hit}
    now = stages["decontamination"](spark, now, SF).cache()
    assert as_rows(now) == want and now.columns == docs.columns

    out = stages["sentencepiece"](spark, now, SF).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in want} and all(r["exact"] for r in out)


def test_awkward_and_empty_tables_pass_every_stage(spark):
    clashing = docs_frame(spark).selectExpr("*", "77 AS n_lines", "'clash' AS root", "'clash' AS component_id", "'clash' AS first")
    for docs in (clashing, empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.count()
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
                if "n_lines" in docs.columns:
                    assert {tuple(r) for r in out.select("n_lines", "n_removed", "root", "fp", "score").distinct().collect()} <= \
                        {(77, "clash", "clash", "clash", "clash")}, name
            else:
                assert out.count() == docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = as_rows(corpus_pipeline.drop_near_duplicates(spark, docs_frame(spark), SF))
    ids = [i for i, _ in rows]
    copy = next(r[1] for r in awkward_docs() if r[0] == 1)
    assert 1 in ids and 2 not in ids and (None, copy) not in rows
    assert sum(not (t or "").split() for _, t in rows) == 1


def test_groups_without_ids_shrink_to_one_row(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(None, text), (None, text), (None, text + " "), (7, "other text of its own"), (7, "other text of its own"),
            (8, "a different one"), (9, "a different one"), (None, "a different one")]
    docs = docs_frame(spark, [(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").split()[0]) for r in got), key=str) == [(7, "other"), (8, "a"), (None, "w0")]


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLES) == {"op2_line_dedup", "op10_warc", "op13_fill_in_middle"}
    assert line_dedup.MIN_WORDS == 50


def test_clean_rows_stay_beside_contaminated_ones_under_their_id(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 20")
    passage = items.orderBy("item_id").first()["text"]
    rows = [(None, f"before {passage} after"), (None, "clean without an id"), (1, passage), (1, "clean under a shared id"),
            (2, passage), (2, passage), (3, "clean"), (None, None), (4, None)]
    docs = docs_frame(spark, [(i, t, "en", "a", 1) for i, t in rows], extra=False)
    got = corpus_pipeline.drop_benchmark(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == \
        sorted(((i, t) for i, t in rows if passage not in (t or "")), key=str)
