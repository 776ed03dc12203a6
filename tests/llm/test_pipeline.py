import hashlib

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def rows(spark):
    return "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark, rows, tmp_path):
    docs = spark.read.parquet(f"{rows}/documents.parquet").limit(120)
    counts, columns = [docs.count()], docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, rows).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == columns, name
        if i == 4:
            texts = [hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()]
            assert sorted(texts) == sorted(r.decoded_sha256 for r in out.collect())
        docs = out
        counts.append(out.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0
