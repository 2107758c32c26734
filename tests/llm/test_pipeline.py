"""Every stage of the pipeline against brute force, on its own input."""

import hashlib

import pytest

import corpus_pipeline as cp
from tests.llm import test_decontam, test_linededup, test_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in cp.STAGES:
        where = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(where)
        docs = spark.read.parquet(where)
        out.append((name, docs.columns, docs.collect()))
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages[1:]] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for _, columns, _ in stages[:-1]:
        assert columns == stages[0][1]


def test_language_id_keeps_clean_documents(stages):
    assert sorted(stages[1][2]) == sorted(r for r in stages[0][2] if any(c.isalpha() for c in r.text or ""))


def test_line_dedup(stages):
    want = test_linededup.plain([(r.doc_id, r.text) for r in stages[1][2]])
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[2][2]) == sorted((i, h) for i, _, _, h in want)
    assert all(r.n_chars == len(r.text) for r in stages[2][2])


def test_near_dedup(stages):
    comps = test_simhash.plain_components({r.doc_id: test_simhash.plain_fingerprint(r.text) for r in stages[2][2]})
    assert sorted(stages[3][2]) == sorted(r for r in stages[2][2] if comps[r.doc_id] == r.doc_id)
    assert len(stages[3][2]) < len(stages[2][2])


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(stages[4][2]) == sorted(r for r in stages[3][2] if not test_decontam.plain(r.text, items)[1])
    assert len(stages[4][2]) < len(stages[3][2])


def test_sentencepiece(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=cp.PIECE_MODEL)
    assert sorted((r.doc_id, r.ids, r.n_tokens, r.decoded) for r in stages[5][2]) == sorted((r.doc_id, ids, len(ids), r.text) for r in stages[4][2] for ids in [library.encode(r.text)])


def test_run(spark, stages):
    assert sorted(r.doc_id for r in cp.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[5][2])


def test_null_and_empty_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "some text without id that is long enough", "en", "x", 40), (3, "some text that goes through all of it", "en", "x", 37), (3, "some text that goes through all of it", "en", "x", 37)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for given in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            given = stage(spark, given, SF)
            assert given.columns == docs.columns
        cp.STAGES[-1][1](spark, given, SF).collect()
