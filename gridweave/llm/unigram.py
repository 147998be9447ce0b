"""Token counts under a unigram vocabulary, by a trie of pre-tokens.

A pre-token's count is the number of tokens in its segmentation of the highest
summed score (of fewest tokens among equals).  Distinct pre-tokens are inserted
in a trie of bytes; the forward score of a prefix lives in its node and is
computed once, however many pre-tokens share the prefix; a node where a
pre-token ends gives its count.  A task's trie is bounded and starts anew when
it is full, which changes no result.

The scores are those of a vocabulary in rank order under Zipf's law:
``-ln(rank + 1)``, less the log of the normaliser.  All single bytes are tokens,
so every text has a segmentation.

Defined results: null and empty texts have no pre-token and no token; texts of
any length are read whole; repeated rows repeat their result; special strings
are ordinary text; columns of the output's names are replaced.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridweave.llm.bpe import batches
from gridweave.llm.pretokens import splitter

#: Trie nodes of a task before it starts anew.
NODES = 600_000


@lru_cache(maxsize=2)
def scores(path: str) -> tuple[dict[bytes, float], int]:
    """Score of each token of a rank file, and the longest token's length."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}, max(map(len, ranks))


class Trie:
    """Forward scores of prefixes.  A node is [children, score, tokens]."""

    def __init__(self, path: str):
        self.score, self.longest = scores(path)
        self.clear()

    def clear(self) -> None:
        self.root: list = [{}, 0.0, 0]
        self.nodes, self.ends = 1, {}

    def insert(self, word: str) -> int:
        """The token count of a pre-token; new prefixes are scored."""
        data, node, path = word.encode(), self.root, [self.root]
        score = self.score
        for i, b in enumerate(data, 1):
            child = node[0].get(b)
            if child is None:
                best, count = -math.inf, 0
                for n in range(1, min(i, self.longest) + 1):
                    s = score.get(data[i - n:i])
                    if s is not None:
                        before = path[i - n]
                        total = before[1] + s
                        if total > best or total == best and before[2] + 1 < count:
                            best, count = total, before[2] + 1
                child = node[0][b] = [{}, best, count]
                self.nodes += 1
            node = child
            path.append(node)
        self.ends[word] = node[2]
        return node[2]


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    """One trie for all tasks of a Python worker."""
    return Trie(path)


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", pretokens: str = "n_pretokens", tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the numbers of pre-tokens and of tokens of each text."""
    keep = [c for c in docs.columns if c not in (pretokens, tokens)]
    source = docs.select(*keep)
    schema = T.StructType([*source.schema.fields, T.StructField(pretokens, T.LongType()), T.StructField(tokens, T.LongType())])

    def run(parts):
        import pyarrow as pa

        known, split = trie(path), splitter(pattern)
        for batch in parts:
            whole = [t or "" for t in batch.column(keep.index(text)).to_pylist()]
            sizes, sums = [], []
            for a, b in batches(whole):
                cut = [split(t) for t in whole[a:b]]
                if known.nodes > NODES:
                    known.clear()
                for w in sorted({p for c in cut for p in c} - known.ends.keys()):  # neighbours share their path
                    known.insert(w)
                sizes += map(len, cut)
                sums += [sum(map(known.ends.__getitem__, c)) for c in cut]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=[*keep, pretokens, tokens])

    return source.mapInArrow(run, schema)
