import os
import sys

import pytest

import corpus_pipeline
from inkspan.llm import bagminhash, bpe, langid, pii, positional, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in langid.identify(docs, langid.fit(docs)).collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    kept = {r.doc_id for r in bagminhash.groups(docs.where(docs.doc_id.isin(list(known)))).collect() if r.kept}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = {r.doc_id for r in positional.search(positional.build_index(docs, items), items).collect() if not r.contaminated}
    want = bpe.round_trip(pii.redact(docs.where(docs.doc_id.isin(list(kept & clean)))), queries.tokenizer_path())
    got = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() > 150


def test_stages_on_empty_tables_and_extra_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs.limit(0), docs.limit(30).selectExpr("*", "1 as score", "'x' as group_id", "2 as _text")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name != "tokens":
                assert out.columns == rows.columns
            out.write.parquet(path := str(tmp_path / f"{name}{len(rows.columns)}{rows.count()}"))
            rows = spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    import oracle_check as oc

    ok, said = oc.compare(spark, oc.connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, said
