"""The pipeline against a plain version, its oracles, and awkward documents."""

import hashlib

import pytest

import corpus_pipeline as C
from trialspan.llm.mixing import dimensions, mix
from trialspan.llm.quality import score, train

from .test_dedup import exact_wanted, near_wanted

SF = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark):
    import sentencepiece

    from trialspan.llm.pieces import model_path
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in score(docs, train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.score >= .5}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    exact = exact_wanted(rows)
    rows = [(i, t) for i, t in rows if any(k[0] == i and v[0] == i for k, v in exact.items())]
    near = near_wanted(rows, 5)
    rows = dict((i, t) for i, t in rows if near[i][1] == i)
    mixed = {r.doc_id for r in mix(docs.where(docs.doc_id.isin(list(rows))), dimensions()).collect() if r.sampled}
    got = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert set(got) == mixed and 0 < len(mixed) < len(rows)
    for i, r in got.items():
        ids = sp.encode(rows[i] or "")
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert r.text == rows[i]


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stages_take_awkward_documents(spark, docs, name, stage):
    got = stage(spark, docs, SF)
    assert set(docs.columns) <= set(got.columns) and (name == "token_ids" or got.columns == docs.columns)
    assert 0 < got.count() <= docs.count()
    assert stage(spark, docs.limit(0), SF).count() == 0
