"""Token counts under a unigram model, by dynamic programming shared in a trie.

The vocabulary is a public byte-level rank file; piece r of V has probability proportional to 1 / (r + OFFSET).  A
pre-token is a word with a space before it; its count is that of the best-scoring segmentation, ties to the fewest
pieces.  Pre-tokens are inserted in a trie whose nodes hold the forward score of their prefix, so a shared prefix is
computed once.  Null and empty texts have no tokens; equal texts get equal counts; repeated
rows are counted each; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import as_bytes, documents, map_batches

OFFSET = 10
NODES = 1_500_000  # trie nodes a task keeps before it starts anew: bounded memory, same results
TERMINALS = 400_000
LONG_WORD = 10_000  # bytes; longer words are scored forward without nodes, with the same results


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_scores(path: str) -> dict[bytes, float]:
    """Piece -> natural log probability."""
    with open(path, "rb") as f:
        ranks = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
    total = math.log(sum(1 / (r + OFFSET) for _, r in ranks))
    return {piece: -math.log(r + OFFSET) - total for piece, r in ranks}


class Trie:
    """children: (node << 8 | byte) -> node; each node keeps its prefix's best score, piece count and parent path."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, text: bytes) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of text."""
        children, score, count, pieces, longest = self.children, self.score, self.count, self.pieces, self.longest
        node, path = 0, [0]
        for depth, byte in enumerate(text, 1):
            key = node << 8 | byte
            node = children.get(key, -1)
            if node < 0:
                best, fewest = -math.inf, 0
                for start in range(max(0, depth - longest), depth):
                    p = pieces.get(text[start:depth])
                    if p is not None:
                        before = path[start]
                        s, c = score[before] + p, count[before] + 1
                        if s > best or s == best and c < fewest:
                            best, fewest = s, c
                node = children[key] = len(score)
                score.append(best)
                count.append(fewest)
            path.append(node)
        return count[node], score[node]


def forward(text: bytes, pieces: dict[bytes, float], longest: int) -> tuple[int, float]:
    """(pieces, score) of the best segmentation, with the last ``longest`` scores in memory only."""
    score, count = deque([0.0], longest), deque([0], longest)
    for depth in range(1, len(text) + 1):
        best, fewest, first = -math.inf, 0, depth - len(score)
        for start in range(first, depth):
            p = pieces.get(text[start:depth])
            if p is not None:
                s, c = score[start - first] + p, count[start - first] + 1
                if s > best or s == best and c < fewest:
                    best, fewest = s, c
        score.append(best)
        count.append(fewest)
    return count[-1], score[-1]


class Terminals(dict):
    """Pre-token -> (count, score), filled from the trie; both are emptied when they reach their bounds."""

    def __init__(self, pieces: dict[bytes, float]):
        super().__init__()
        self.trie = Trie(pieces)

    def __missing__(self, word: bytes) -> tuple[int, float]:
        if len(word) > LONG_WORD:
            return forward(b" " + word, self.trie.pieces, self.trie.longest)
        if len(self.trie.score) > NODES:
            self.trie.clear()
        if len(self) > TERMINALS:
            self.clear()
        value = self[word] = self.trie.insert(b" " + word)
        return value


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_pretokens, n_tokens, score (natural log); a map, no exchange."""
    path = path or vocabulary_path()

    def start():
        terminals = Terminals(load_scores(path))

        def count(b: bytes) -> tuple[int, int, float]:
            found = [terminals[w] for w in b.split()]
            return len(found), sum(x[0] for x in found), sum(x[1] for x in found)

        def step(batch: pa.RecordBatch) -> dict:
            rows = [count(b) for b in as_bytes(batch.column(1))]
            return {"doc_id": batch.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(("n_pretokens", "n_tokens", "score"))}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), start, "doc_id long, n_pretokens long, n_tokens long, score double")


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
