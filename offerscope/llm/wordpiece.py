"""Token counts: a linear longest-match automaton over a vocabulary of word pieces.

The vocabulary trie has a failure link and a count of popped tokens at every node. When no child
continues the match, the count is added and the link followed, so each word is read once and neither
piece strings nor back-tracking are needed (the method of "Fast WordPiece Tokenization", 2021).

Defined results: words are maximal runs of non-space characters; a word that the vocabulary cannot
spell counts as one unknown token; null and empty texts have zero words and tokens. Repeated rows are
counted each on its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, Memo, batches_of, table, texts_of

MARK = "▁"
_UNKNOWN = 1 << 44


class LongestMatch:
    """Counts greedy longest-match pieces; pieces that begin with ``mark`` start a word."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        self.children: list[dict[str, int]] = [{}, {}]
        self.inner, self.first = 0, 1
        ends = set()
        for piece in pieces:
            starts = piece.startswith(mark)
            node = self.first if starts else self.inner
            for char in piece[len(mark):] if starts else piece:
                found = self.children[node].get(char)
                if found is None:
                    found = self.children[node][char] = len(self.children)
                    self.children.append({})
                node = found
            if node != self.inner:
                ends.add(node)
        self.link: list[int | None] = [None] * len(self.children)
        self.popped = [0] * len(self.children)
        if self.first in ends:
            self.link[self.first], self.popped[self.first] = self.inner, 1
        for root in (self.inner, self.first):
            self._link_below(root, ends)

    def _link_below(self, root: int, ends: set[int]) -> None:
        """Breadth first, so the shorter strings that links point to are done before."""
        queue = deque([root])
        while queue:
            node = queue.popleft()
            for char, child in self.children[node].items():
                if child in ends:
                    self.link[child], self.popped[child] = self.inner, 1
                else:
                    count, at = self.popped[node], self.link[node]
                    while at is not None and char not in self.children[at]:
                        count, at = count + self.popped[at], self.link[at]
                    if at is not None:
                        self.link[child], self.popped[child] = self.children[at][char], count
                queue.append(child)

    def count(self, word: str) -> int | None:
        """Pieces of a word, None if it cannot be spelt."""
        children, link, popped = self.children, self.link, self.popped
        node, total = self.first, 0
        for char in word:
            following = children[node].get(char)
            while following is None:
                if link[node] is None:
                    return None
                total += popped[node]
                node = link[node]
                following = children[node].get(char)
            node = following
        while node != self.inner:
            if link[node] is None:
                return None
            total += popped[node]
            node = link[node]
        return total


def sentencepiece_vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a model file: no control, unknown, unused or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not any(test(i) for test in special)]


def count_tokens(df: DataFrame, pieces: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and n_words, n_tokens, n_unknown of every whole text; a map without shuffle.

    The vocabulary is broadcast: its size does not depend on the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(pieces))
    narrow = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))

    def counted(batches: Batches):
        automaton = LongestMatch(shared.value)

        def code(word: str) -> int:
            n = automaton.count(word)
            return _UNKNOWN + 1 if n is None else n

        memo = Memo(code)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for value in texts_of(batch, "_text"):
                split = value.split()
                unknowns, total = divmod(sum(map(memo.__getitem__, split)), _UNKNOWN)
                words.append(len(split))
                tokens.append(total)
                unknown.append(unknowns)
            kept = {c: (batch.column(c), None) for c in keep}
            yield batches_of(kept | {"n_words": (words, pa.int64()), "n_tokens": (tokens, pa.int64()), "n_unknown": (unknown, pa.int64())})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(counted, f"{kinds}, n_words long, n_tokens long, n_unknown long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op10_token_counts": op10_token_counts}
