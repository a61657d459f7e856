"""Token counts by a unigram model: dynamic programming shared along a trie of distinct pre-tokens.

A pre-token is a word with U+2581 before it. Its segmentation is the sequence of vocabulary pieces with the
largest sum of log probabilities; a character outside the vocabulary is one piece of a fixed low score. The
forward score of a prefix depends on the prefix alone, so distinct pre-tokens are inserted in a trie and each
node's score and piece count are computed once, when the node is made; the node at which a pre-token ends holds
its count. Of equal scores the fewer pieces win.

The public vocabulary files state merge ranks, not probabilities. Ranks follow falling frequency, so piece r gets
the Zipf log probability -log(r + 2) - log(H), where H makes the sum over all pieces 1.

The trie belongs to a worker and is emptied when it has ``NODES`` nodes, before the next word. Words of more than
``LONG`` characters get no nodes: only the scores of the last few prefixes, as many as the longest piece has
characters, are kept. So a worker's memory is bounded whatever the words, and no count changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import text_bytes

NODES = 400_000
LONG = 1_000
TERMINALS = 800_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Pieces in order of rank; a repeated piece keeps its first rank."""
    norm = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    out: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        out.setdefault(piece, -math.log(r + 2) - norm)
    return out


@lru_cache(maxsize=2)
def load_scores(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece model file, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return zipf_scores([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))])


class TrieCounter:
    """``count(word)`` with forward scores kept in trie nodes: [score, pieces, children]."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES) -> None:
        self.scores, self.limit = scores, nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.terminals = _Terminals(self)
        self.clear()

    def clear(self) -> None:
        self.root: list = [0.0, 0, {}]
        self.size = 1

    def count_long(self, word: str) -> int:
        """``count`` with the scores of the last prefixes only."""
        scores, longest, unknown = self.scores, self.longest, self.unknown
        kept = [(0.0, 0)] * (longest + 1)  # of the prefix of d characters at d modulo the size
        size = longest + 1
        for d in range(1, len(word) + 1):
            prior = kept[(d - 1) % size]
            best, pieces = prior[0] + unknown, prior[1] + 1
            for start in range(max(0, d - longest), d):
                s = scores.get(word[start:d])
                if s is not None:
                    before = kept[start % size]
                    total = before[0] + s
                    if total > best or total == best and before[1] + 1 < pieces:
                        best, pieces = total, before[1] + 1
            kept[d % size] = (best, pieces)
        return kept[len(word) % size][1]

    def count(self, word: str) -> int:
        if len(word) > LONG:
            return self.count_long(word)
        if self.size > self.limit:
            self.clear()
        scores, longest, node, path = self.scores, self.longest, self.root, [self.root]
        for d, c in enumerate(word, 1):
            node = path[-1][2].get(c)
            if node is None:
                prior = path[-1]
                best, pieces = prior[0] + self.unknown, prior[1] + 1
                for start in range(max(0, d - longest), d):
                    s = scores.get(word[start:d])
                    if s is not None:
                        before = path[start]
                        total = before[0] + s
                        if total > best or total == best and before[1] + 1 < pieces:
                            best, pieces = total, before[1] + 1
                node = path[-1][2][c] = [best, pieces, {}]
                self.size += 1
            path.append(node)
        return path[-1][1]


class _Terminals(dict):
    """Counts of whole pre-tokens; the key is the word's bytes without the leading space mark."""

    def __init__(self, trie: TrieCounter) -> None:
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        n = self.trie.count(SPACE + word.decode(errors="replace"))
        if len(word) <= 64:
            if len(self) >= TERMINALS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def loaded(path: str) -> TrieCounter:
    """One trie for each worker process."""
    return TrieCounter(load_scores(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_pretokens, n_tokens of the whole text.

    Null or empty texts have none of either. Null and repeated ids keep their rows; other columns are not read. Bytes
    that are no UTF-8 are read as U+FFFD.
    ``path`` names a sentencepiece model that every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = loaded(path).terminals.__getitem__
        for ids, texts in text_bytes(batches, "id", "raw"):
            words = [raw.split() for raw in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, words), pa.int64()), pa.array((sum(map(get, w)) for w in words), pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
