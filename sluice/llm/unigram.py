"""Token counts by a unigram model, with one trie for all pre-tokens.

The best score of a prefix does not depend on what follows it, so distinct
pre-tokens go into a trie and each node's forward score - the best sum of token
scores over all cuts of its prefix - is computed once, from the nodes above it,
for all pre-tokens that share the prefix. A pre-token's terminal node holds its
number of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluice.llm.bpe import read_ranks

#: Bounds of what a worker keeps; beyond them it starts anew. They change no result.
MAX_NODES, MAX_WORDS = 300_000, 200_000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities by Zipf's law, p proportional to 1 / (rank + 1).

    The vocabulary files carry ranks, not probabilities, and tokenizers are not
    trained here.
    """
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}


class Trie:
    """Nodes are numbers; node 0 is the empty prefix."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def insert(self, word: bytes) -> tuple[int, float]:
        """The number of tokens of word's best cut and its score.

        Of equal scores the cut with fewer tokens counts.
        """
        if len(self.best) > MAX_NODES:
            self.clear()
        edges, best, tokens, scores = self.edges, self.best, self.tokens, self.scores
        path, node = [0], 0
        for depth, byte in enumerate(word, 1):
            edge = node << 8 | byte
            node = edges.get(edge, 0)
            if not node:
                top, count = -math.inf, 0
                for start in range(max(0, depth - self.longest), depth):
                    if (score := scores.get(word[start:depth])) is not None:
                        above = path[start]
                        total, n = best[above] + score, tokens[above] + 1
                        if total > top or total == top and n < count:
                            top, count = total, n
                node = edges[edge] = len(best)
                best.append(top)
                tokens.append(count)
            path.append(node)
        return tokens[node], best[node]


class Counter(dict):
    """Pre-token to (tokens, score); missing ones are computed in the trie."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.split = regex.compile(pattern).findall
        self.trie = Trie(zipf_scores(read_ranks(path)))

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.trie.insert(word.encode())
        if len(word) <= 48:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = found
        return found

    def count(self, text: str) -> tuple[int, int, float]:
        """Pre-tokens, tokens and log-probability of a text."""
        found = list(map(self.__getitem__, self.split(text)))
        return len(found), sum(n for n, _ in found), math.fsum(s for _, s in found)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One counter for each worker process."""
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pretokens, n_tokens, log_prob for every row of docs.

    path is a .tiktoken file that every machine has; pattern cuts the
    pre-tokens. A null or empty text has no tokens and log_prob 0. Rows stay in
    their partitions, so there is no shuffle; other columns are not read.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint, log_prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            found = [c.count(value.as_py() or "") for value in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "n_pretokens", "n_tokens", "log_prob"])

    return docs.select(key, docs[text].cast("string")).mapInArrow(run, schema)
