"""Searches in blocks: the SQL's results on odd tables, and plans without a row a pair of question and chunk."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from basalt.operators import retrieval
from basalt.plans import catalogue, search
from test_queries import norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, a document of more than 1000 lines, equal lines, a null text and question, equal vectors."""
    folder = str(tmp_path_factory.mktemp("odd"))
    pick = random.Random(5)
    words = ["ab", "cd-3", "Efgh", "ijkl", "mnño", "x", "-", "\t", "long-er"] + [f"t{i}abc" for i in range(60)]
    line = lambda: " ".join(pick.choice(words) for _ in range(pick.randint(0, 12)))
    texts = ["\n".join(line() for _ in range(pick.randint(1, 9))) for _ in range(60)] + ["\n".join(line() for _ in range(1203)), "same line here ab\n" * 30, None, ""]
    ids = [*range(50), 7, 7, None, None, *range(60, 70)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*((i, line() + " ab") for i in range(9)), (20, "nothing-known"), (21, None), (22, "same line ab ab here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(60, 8)).astype(np.float32)
    vectors[20:50] = vectors[20]
    spark.createDataFrame([*((i * 3, v.tolist()) for i, v in enumerate(vectors)), (None, [1.0] * 8)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, rel = catalogue.QUERIES[name](spark, folder), con.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    have, at = df.collect(), [rel.columns.index(c) for c in columns]
    assert have and sorted(tuple(norm(r[c]) for c in columns) for r in have) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(search.QUERIES))
def test_odd_tables_match_sql(spark, odd, name):
    same(spark, odd, name)


@pytest.mark.parametrize("name", sorted(search.QUERIES))
def test_no_row_a_pair(spark, name):
    """Neither words nor pairs are made rows of: chunks meet questions inside tasks."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "regexp_extract_all(lower(line" not in plan


def test_vectors_of_two_lengths_fall_back(spark, odd, tmp_path):
    spark.read.parquet(f"{odd}/embeddings.parquet").where("vec_id < 40").unionByName(spark.createDataFrame([(100, [1.0]), (101, [2.0, 3.0])], "vec_id long, embedding array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert retrieval.dense_ready(spark.read.parquet(f"{tmp_path}/embeddings.parquet")) is None
    assert catalogue.QUERIES["dense_topk"](spark, str(tmp_path)).count() == 16 * 6


def test_terms_are_those_of_the_pattern():
    pick = random.Random(1)
    for _ in range(300):
        lines = [pick.choice([None, "".join(pick.choice("ab1-- ñ\n.é") for _ in range(pick.randint(0, 9)))]) for _ in range(pick.randint(0, 6))]
        found, n = retrieval.terms(pa.array(["a", *lines, "q"], pa.string())[1:-1])
        want = [re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", x or "") for x in lines]
        assert found.to_pylist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_scores_round_as_spark_does(spark):
    x = np.array([0.0000005, 1.0000005, -2.0000005, 0.1234565, 0.1234564999, 17.0000015, 3.0, 0.0])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("round(x, 6)").collect()]
    assert (retrieval.micro(x) / retrieval.SCALE).tolist() == want
