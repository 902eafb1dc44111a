"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A text's sketch holds every hash of its five-word shingles that is below a fixed fraction of the hash space (a text
of one to four words has one shingle, its words together).  Sketches of parts merge by union, and because the
threshold is the same everywhere, the overlap of two sketches estimates resemblance or containment even between very
unequal texts.

Null texts are empty ones, with an empty sketch; texts without retained hashes are alike only if they are equal;
repeated rows follow each other, ordered by id, then text; null ids come first; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from basalt.llm.common import documents, stage

SHINGLE = 5
FRACTION_BITS = 3  # hashes below 2^-3 of the space are retained
BUCKET_ROWS = 2_048  # rows of a window partition, where ids are even between two cuts
CUTS = 256
SPACE = r"[\x20\x09-\x0D]+"


def sketch(text: Column) -> Column:
    """Sorted distinct retained shingle hashes of a text without nulls."""
    words = F.array_remove(F.split(text, SPACE), "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    # a one-element transform binds the words once: without it each use of the column would split the text again
    every = F.flatten(F.transform(F.array(words), hashes))
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: (h >= 0) & (h < F.lit(1 << (64 - FRACTION_BITS))))))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if nothing of a is retained."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Estimated resemblance; for two empty sketches whether the texts are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, (text_a == text_b).cast("double")).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(text: Column, hashes: Column) -> Column:
    """Fingerprint string: the whole text's hash, then the sketch."""
    return F.concat(F.hex(F.xxhash64(text)), F.lit(":"), F.concat_ws(",", F.transform(hashes, lambda h: F.hex(h))))


def with_next(docs: DataFrame, payload: dict[str, Column], schema_order: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs(doc_id, text) plus the payload columns and ``next``, a struct of text and payload of the row after it.

    Ids are dealt to buckets by value, evenly between approximate quantiles, so outlying ids crowd no bucket; the order
    is found bucket by bucket, and the first row of each bucket, found from the ids alone, is sent to the bucket before
    it.  The text is exchanged once.
    """
    n, cuts = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", [k / CUTS for k in range(CUTS + 1)], 10 * CUTS)).first()
    cuts = sorted(set(cuts or [0]))
    parts = max(1, -(-n // (CUTS * BUCKET_ROWS)))  # buckets between two cuts
    edges = F.array(*(F.lit(c).cast("long") for c in cuts))

    def place(at: Column) -> Column:
        low, high = F.get(edges, at), F.coalesce(F.get(edges, at + 1), F.get(edges, at) + 1)
        inside = F.floor((F.col("doc_id") - low).cast("double") / (high - low) * parts)
        return at.cast("long") * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))

    at = F.greatest(F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))
    bucket = F.coalesce(F.element_at(F.transform(F.array(at), place), 1), F.lit(-1).cast("long"))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(bucket)
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first_id"))
    over = Window.orderBy("bucket")  # one row for some thousands of documents
    whole = Window.partitionBy()
    following = F.coalesce(F.lead("first_id").over(over), F.first("first_id").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    has_null = F.max((F.col("bucket") == -1).cast("int")).over(whole)
    last = F.row_number().over(over) == F.count("*").over(whole)
    # the row after the last one is the first: of the null ids, if there are any
    firsts = stage(firsts.select("bucket", F.when(last & (has_null == 1), F.lit(None)).otherwise(following).alias("next_id")))
    heads = docs.join(firsts.withColumnRenamed("bucket", "to_bucket"), F.col("doc_id").eqNullSafe(F.col("next_id"))).groupBy("to_bucket").agg(F.min("text").alias("text"))
    heads = heads.withColumns(payload).select("to_bucket", F.struct("text", *payload).alias("head"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = docs.withColumns(payload).withColumn("bucket", bucket).withColumn("next", F.lead(F.struct("text", *payload)).over(inside))
    joined = rows.join(heads, (rows["bucket"] == heads["to_bucket"]) & rows["next"].isNull(), "left")
    return joined.select("doc_id", "text", *payload, F.coalesce("next", "head").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> fingerprints of each text and of its edited form, and their likeness."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, {"sketch": sketch(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    # bound once, by a projection between, so that the sketch is computed once
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("text"), F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next.sketch"), F.col("text"), F.col("next.text")).alias("near_next"),
    )


def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
