"""Document queries against brute force on tables with more documents than a prefix of ids holds."""

from collections import Counter

import pyarrow as pa

from basalt.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_chunks_cover_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for doc_id, text in docs:
        want[doc_id] += sum(line.strip(" ") != "" for line in (text or "").split("\n"))
    got = catalogue.QUERIES["paragraph_elements"](spark, SF).collect()
    assert max(want) >= 300 and Counter(int(r.chunk_id.split("#")[0]) for r in got) == +want


def test_every_question_and_vector_is_asked(spark):
    small = "/root/testdata/sf0.001"
    items = {r.item_id for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id").collect()}
    vectors = {r.vec_id for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id").collect()}
    asked = lambda name: {r.item_id for r in catalogue.QUERIES[name](spark, small).select("item_id").collect()}
    assert len(items) > 5 and asked("term_coverage") == items and len(asked("bm25_topk")) > 5
    assert len(vectors) > 5 and asked("dense_topk") == vectors


def test_chunks_of_long_texts_come_in_bounded_parts(spark):
    """One batch of documents is handed on in many parts, so no task holds all its chunks."""
    from basalt.functions import text
    from basalt.operators import retrieval

    pages = [None, "", " \t", "x" * 2000, *(" ".join(f"word{i} of{j}." for j in range(400)) for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string").coalesce(1)
    got = text.split_column(docs, "text", 800, 120)
    want = [(i, n, c) for i, t in enumerate(pages) for n, c in enumerate(text.split_recursive(t or "", 800, 120))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    batch = docs.toArrow().to_batches()[0]
    sizes = [p.nbytes for p in retrieval.parts(pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(1)] * 60)], ["text"]), 0, 1 << 20)]
    assert len(sizes) > 1
    assert "ArrowEvalPython" not in catalogue.QUERIES["chunk_fixed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
