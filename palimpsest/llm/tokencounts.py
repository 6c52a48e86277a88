"""Token counts under a unigram model: distinct pre-tokens share a trie whose nodes hold forward scores.

A node stands for a prefix of some pre-token. Its forward score, the best sum of token scores over all ways to cut
that prefix, depends on the prefix alone, so it is computed once when the node is made, from the nodes above it. The
count of tokens of the best cut is kept for each whole pre-token; among equal scores the cut with fewer tokens counts.

A token's score is -ln(rank + 2), by Zipf's law on its rank in a public byte-level vocabulary: nothing is trained, and
as every byte is a token, every text can be cut. Null and empty texts have no tokens. Repeated rows give equal results.
"""

from __future__ import annotations

import base64
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import annotate, documents, ids_and_texts
from palimpsest.llm.pretokens import find_pretokens

#: Nodes of the trie and entries of the table of counts; at these sizes each is emptied, which changes no result.
TRIE_NODES, TABLE_SIZE = 500_000, 800_000
#: Bytes beyond which a pre-token is not put in the trie or the table, but scored in passing.
LONG = 2000


class ForwardTrie:
    def __init__(self, ranks: dict[bytes, int]):
        self.scores = {token: -math.log(rank + 2) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.counts: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}
        self.forward, self.cuts = [0.0], [0]

    def insert(self, data: bytes) -> int:
        """The tokens of the best cut of one pre-token."""
        children, forward, cuts, scores = self.children, self.forward, self.cuts, self.scores
        node, path = 0, [0]
        for end, byte in enumerate(data, 1):
            key = node << 8 | byte
            node = children.get(key, -1)
            if node < 0:
                best, fewest = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    if (score := scores.get(data[start:end])) is not None:
                        total, n = forward[path[start]] + score, cuts[path[start]] + 1
                        if total > best or total == best and n < fewest:
                            best, fewest = total, n
                node = children[key] = len(forward)
                forward.append(best)
                cuts.append(fewest)
            path.append(node)
        return cuts[node]

    def alone(self, data: bytes) -> int:
        """The same for a long pre-token, which shares no prefix worth keeping: only the last scores are held."""
        scores, longest = self.scores, self.longest
        forward, cuts = [0.0], [0]  # of the last `longest` prefixes and some more
        for end in range(1, len(data) + 1):
            best, fewest, first = -math.inf, 0, end - len(forward)
            for start in range(max(0, end - longest), end):
                if (score := scores.get(data[start:end])) is not None:
                    total, n = forward[start - first] + score, cuts[start - first] + 1
                    if total > best or total == best and n < fewest:
                        best, fewest = total, n
            forward.append(best)
            cuts.append(fewest)
            if len(forward) > 8 * longest:
                del forward[:-longest], cuts[:-longest]
        return cuts[-1]

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        tokens, counts = find_pretokens(text), self.counts
        try:
            return len(tokens), sum(map(counts.__getitem__, tokens))
        except KeyError:
            pass
        if len(counts) >= TABLE_SIZE:
            counts.clear()
        long: dict[str, int] = {}
        for token in set(tokens).difference(counts):
            data = token.encode()
            if len(data) > LONG:
                long[token] = self.alone(data)
                continue
            if len(self.forward) >= TRIE_NODES:
                self.reset()
            counts[token] = self.insert(data)
        return len(tokens), sum(long[t] if t in long else counts[t] for t in tokens)


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file, read where the query is planned and sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Path(path).read_bytes()


def parse_ranks(spec: bytes) -> dict[bytes, int]:
    """A token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, spec.splitlines())}


_TRIES: dict[int, ForwardTrie] = {}


def trie_of(spec: bytes) -> ForwardTrie:
    """One trie in each Python worker, so that its prefixes serve all the worker's tasks."""
    key = hash(spec)
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = ForwardTrie(parse_ranks(spec))
    return _TRIES[key]


def count_tokens(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_pretokens and n_tokens of each whole text."""
    spec = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # one vocabulary file

    def kernel():
        trie = trie_of(spec.value)

        def run(texts: list[bytes]) -> dict:
            found = [trie.count(t.decode()) for t in texts]
            return {"n_pretokens": [x for x, _ in found], "n_tokens": [y for _, y in found]}

        return run

    return annotate(df, text_col, "n_pretokens long, n_tokens long", kernel)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(ids_and_texts(documents(spark, sf_dir))).select("doc_id", "n_pretokens", "n_tokens")
