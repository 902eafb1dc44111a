"""Retrieval queries by exact searches in blocks; their SQL, in ``text``, makes a row of every pair that shares a term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.retrieval import dense_ready, dense_top, lexical_top, term_counts
from basalt.plans import text
from basalt.plans.dialect import SPARK

WORDS = SPARK.words("text")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(docs: DataFrame, variant: str) -> DataFrame:
    """(chunk_id, line) of every chunk, a line, a section or a window of a document, in lower case.

    Where documents share an id, or a document has so many lines that their cut numbers meet, the pieces that share a
    chunk_id are one chunk, as in SQL.
    """
    docs.createOrReplaceTempView("documents")
    chunks = docs.sparkSession.sql(f"with {text.VARIANTS[variant](SPARK)} select {text.doc(SPARK)} as doc, chunk_id, lower(line) as line from chunks")
    one = lambda df: df.groupBy("chunk_id").agg(F.array_join(F.collect_list("line"), "\n").alias("line"))
    if variant == "section":
        return one(chunks)
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    met = docs.groupBy(F.expr(text.doc(SPARK)).alias("doc")).agg(F.count("*").alias("n"), F.max(n_lines).alias("n_lines")).where(f"n > 1 or n_lines >= {text.MAX_LINES}").select("doc")
    if met.isEmpty():
        return chunks.select("chunk_id", "line")
    return chunks.join(met, "doc", "left_anti").select("chunk_id", "line").unionByName(one(chunks.join(met, "doc", "left_semi")))


def lexical(spark: SparkSession, sf_dir: str, variant: str = "line") -> DataFrame:
    """lexical_top of the SQL, with the number of the question's distinct terms that the chunk holds."""
    found = units(read(spark, sf_dir, "documents"), variant)
    found.createOrReplaceTempView(f"units_{variant}")
    return lexical_top(found, read(spark, sf_dir, "benchmark"), WORDS, text.CANDIDATES, text.K1, text.B, text.EPSILON)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    size = dense_ready(vectors)
    if size:
        return dense_top(vectors, size, text.CANDIDATES)
    # vectors of several lengths, with nulls or of one id: their cosines are what the SQL makes of them
    vectors.createOrReplaceTempView("embeddings")
    return spark.sql(f"with {text.dense(SPARK)} select item_id, vec_id, cosine, place from dense_top")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = term_counts(units(read(spark, sf_dir, "documents"), "line")).where(F.length("term") >= text.MIN_TERM)
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_chunks").alias("n_chunks"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir).where(F.col("place") <= text.TOP).select("item_id", "chunk_id", "score", "place")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).where(F.col("place") <= text.TOP).select("item_id", "vec_id", "cosine", "place")


def hybrid_search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical(spark, sf_dir).createOrReplaceTempView("lexical_top")
    dense(spark, sf_dir).createOrReplaceTempView("dense_top")
    return spark.sql(f"with {text.FUSED} {text.FUSED_TOP}")


def judged(spark: SparkSession, sf_dir: str, variant: str = "line") -> str:
    """The CTEs of ``text.contained`` from hits on, over a view of the chunks found."""
    lexical(spark, sf_dir, variant).createOrReplaceTempView(f"found_{variant}")
    read(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return f"""asked as (select item_id, {SPARK.explode(WORDS)} as term from benchmark), asked_n as (select item_id, cast(count(distinct term) as double) as n from asked group by item_id),
      hits as (select l.item_id, l.chunk_id, l.place, l.held / a.n as share from found_{variant} l join asked_n a on a.item_id = l.item_id), {text.JUDGED}"""


def context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"with {judged(spark, sf_dir)} {text.PRECISION}")


def reference_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"with {judged(spark, sf_dir)} {text.RECALL}")


def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(" union all ".join(f"select * from (with {judged(spark, sf_dir, v)} {text.summary(v, f'count(*) from units_{v}')}) as {v}" for v in text.VARIANTS))


QUERIES = {f.__name__: f for f in (bm25_topk, context_precision, reference_recall, dense_topk, hybrid_search_rrf, ablation_summary, vocabulary,)}
