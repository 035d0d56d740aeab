"""Every query and stage on awkward and on empty tables."""

import hashlib

import pytest

import corpus_pipeline
from quire.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    out = QUERIES[name](spark, empty_dir)
    assert out.columns and out.collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op6_decontaminate", "op11_packing", "op12_phrases"}))
def test_a_row_for_every_row(spark, odd_dir, name):
    got = QUERIES[name](spark, odd_dir).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 2, 3, 4, 5, 6, 7]


def test_defined_results(spark, odd_dir):
    rows = {n: {r.doc_id: r for r in QUERIES[n](spark, odd_dir).collect()} for n in QUERIES
            if n not in ("op6_decontaminate", "op12_phrases")}
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (3, 4):
        assert rows["op1_language_id"][i].lang_pred == "und" and rows["op1_language_id"][i].score == 0
        assert rows["op2_minmax_near_dup"][i].component_id == i and rows["op2_minmax_near_dup"][i].n_shingles == 0
        assert rows["op3_token_shards"][i].n_tokens == 1
        assert (rows["op4_byte_bpe"][i].n_tokens, rows["op4_byte_bpe"][i].ids_sha256) == (0, nothing)
        assert rows["op5_quality_rules"][i].base_failed and not rows["op5_quality_rules"][i].kept
        assert rows["op9_secret_scan"][i].base_sha256 == nothing
        assert rows["op10_pii"][i].spans == ""
        assert (rows["op11_packing"][i].length, rows["op11_packing"][i].doc_tokens) == (1, 1)
    for i in (3, 4):
        assert tuple(rows["op13_alignment"][i])[1:] == (0,) * 6 + ("",)
    assert rows["op13_alignment"][5].n_a > 0 and rows["op13_alignment"][7].n_groups > 1
    assert rows["op2_minmax_near_dup"][2].component_id == 1 and not rows["op2_minmax_near_dup"][2].kept
    assert rows["op2_minmax_near_dup"][None].component_id is None
    assert rows["op2_minmax_near_dup"][6].n_shingles == 3
    assert rows["op1_language_id"][None].held_out is False
    assert rows["op7_toxicity"][3].predicted in (0, 1)


def test_packing_of_odd_documents(spark, odd_dir):
    """Repeated rows and null ids are documents of their own, and a very long one is cut into full windows."""
    rows = QUERIES["op11_packing"](spark, odd_dir).collect()
    assert sum(r.start == 0 for r in rows) == 9 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    long = [r for r in rows if r.doc_id == 6]
    assert sum(r.length for r in long) == long[0].doc_tokens and sum(r.length == 2048 for r in long) >= long[0].doc_tokens // 2048
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 2)


def test_phrases_of_odd_documents(spark, odd_dir):
    got = {(r.lang, r.phrase): r for r in QUERIES["op12_phrases"](spark, odd_dir).collect()}
    assert {k[0] for k in got} == {"de"} and got["de", "lorem ipsum dolor lorem"].n == 60_000
    assert got["de", "lorem ipsum dolor lorem"].a == 19_999 and ("de", "lorem ipsum") not in got


def test_decontamination_of_odd_items(spark, odd_dir):
    got = QUERIES["op6_decontaminate"](spark, odd_dir).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (2, 1)]


def test_pipeline_stages_keep_columns(spark, odd, odd_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).count() == 9


def test_pipeline_on_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_long_benchmark_items_are_verified_whole(spark):
    from quire.llm import decontam
    question = " ".join(f"ask{i}" for i in range(200)) + ". "
    items = [(1, " ".join([f"item{i}" for i in range(256)] + ["common"])),     # 257 words
             (2, " ".join(f"long{i}" for i in range(900)) + ". The answer is never given there at all"),
             (3, question + " ".join(f"end{i}" for i in range(180)))]
    docs = [(1, "a common word and more of the same"), (2, "so " + items[0][1] + " it ends"), (3, items[1][1].split(".")[0]),
            (4, "x " * 700 + items[1][1]), (5, question), (6, items[2][1] + " y" * 900), (7, " ".join(items[1][1].split()[:600]))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items).collect()}
    assert sorted(got) == [(2, 1), (4, 2), (6, 3)]
    assert all(r.overlap == r.question_overlap == r.answer_overlap == 1.0 for r in got.values())
    assert sorted(r.doc_id for r in decontam.without_contaminated(docs, items).collect()) == [1, 3, 5, 7]
