"""Text functions that SQL has no words for; Arrow-batched."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from basalt.operators.retrieval import parts

# What a fact looks like (a code with digits, or a number with decimals, not inside a word).
FACTS = r"(?<![A-Za-z0-9])(?:[A-Z]{2,}-\d+|\d+(?:[.,]\d+)?)"
# Separators of the recursive splitter, coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")
BLOCK = re.compile(r"<(h[1-6]|p|li|td|th)\b[^>]*>(.*?)</\1>", re.S | re.I)
HIDDEN = re.compile(r"<(script|style)\b.*?</\1>", re.S | re.I)
TAG = re.compile(r"<[^>]+>")


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that fits; each begins with the end of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if s in text), "")
    if not mark:
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]
    finer = separators[separators.index(mark) + 1 :]
    chunks, held, length = [], [], 0
    for part in text.split(mark):
        part += mark
        if len(part) > size:
            if held:
                chunks.append("".join(held))
                held, length = [], 0
            chunks += split_recursive(part, size, overlap, finer)
            continue
        if length + len(part) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if "".join(held).strip():
        chunks.append("".join(held))
    return [c.strip() for c in chunks if c.strip()]


def blocks(page: str) -> list[dict]:
    """Typed blocks of a page in order: heading, prose, step, cell."""
    kinds = {"p": "prose", "li": "step", "td": "cell", "th": "cell"}
    out = []
    for m in BLOCK.finditer(HIDDEN.sub(" ", page)):
        words = " ".join(html.unescape(TAG.sub(" ", m[2])).split())
        if words:
            out.append({"kind": kinds.get(m[1].lower(), "heading"), "text": words})
    return out


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def split_column(df: DataFrame, text: str, size: int, overlap: int, whole: bool = False) -> DataFrame:
    """df with a row a chunk of the column text: its other columns, n from 0, and chunk.

    whole: texts of at most size characters are kept as they are, blank ones too.  A task holds the chunks of one part
    of a batch at a time, however long the texts are.
    """
    others = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*others, StructField("n", LongType()), StructField("chunk", StringType())])
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(others), batch.num_rows):
                rows, places, chunks = [], [], []
                for i, t in enumerate(part.column(len(others))):
                    t = t.as_py() or ""
                    found = [t] if whole and len(t) <= size else split_recursive(t, size, overlap)
                    rows += [i] * len(found)
                    places += range(len(found))
                    chunks += found
                columns = [part.column(i).take(pa.array(rows, pa.int64())) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow)), pa.array(places, pa.int64()), pa.array(chunks, arrow.types[-1])], schema=arrow)

    return df.select(*(f.name for f in others), text).mapInArrow(split, schema)


@pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())])))
def page_blocks(pages: pd.Series) -> pd.Series:
    return pd.Series([blocks(p or "") for p in pages])


@pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain(t))
