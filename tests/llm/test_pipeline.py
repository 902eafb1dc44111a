import pytest

from test_operators import SCHEMA, TEXTS, rows

import corpus_pipeline
from basalt.llm.common import stage


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    labels = [(i, 1, int(100 <= i < 200 and (i - 100) % 3 == 0)) for i, _ in TEXTS if i is not None and i >= 100]
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.dtypes, {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        docs = stage(function(spark, docs, sf_dir))
        seen[name] = docs.toPandas()
        if k < 4:
            assert docs.dtypes == columns, name
            assert set(seen[name].toxicity) == {"keep"}  # a clashing column comes through
    toxic = {100 + i for i in range(0, 60, 3)}
    kept = set(seen["toxicity"].doc_id.dropna().astype(int))
    assert len(toxic & kept) <= 1 and kept >= {3, 4, 5, 8}
    near = seen["near_dedup"]
    assert len({3, 4, 5} & set(near.doc_id.dropna().astype(int))) == 1 and near.doc_id.duplicated().sum() <= 2
    cut = seen["suffix_dedup"]
    assert len(cut) == len(near) and (cut.n_chars == cut.text.fillna("").str.len()).all()
    six, seven = (cut[cut.doc_id == i].text.iloc[0] for i in (6, 7))
    assert len(six) < 300 and len(seven) < 300
    assert set(seen["mixing"].doc_id.dropna()) <= set(cut.doc_id.dropna()) and (seen["mixing"].groupby("doc_id").size() <= 4).all()
    assert seen["packing"].groupby("sequence_id").length.sum().max() <= 2048


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {"doc_id", "piece", "sequence_id"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
