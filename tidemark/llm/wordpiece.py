"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie with two roots: pieces that begin a word and pieces that continue one. A failure link says where to go
when the next character has no edge, and how many pieces that gives up; both are computed once per node, so a word is counted
in one pass over its characters, whatever the lengths of the pieces. Words recur, so each batch counts its distinct words.
"""

from __future__ import annotations

import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, slices

_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
_CACHE = 200_000


class Automaton:
    """Longest-match counter for word-initial and continuing pieces."""

    def __init__(self, initial: list[str], inner: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = self.edges[node][c]
                ends[node] = ends[node] or bool(piece)
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([(0, c, n) for c, n in self.edges[0].items()] + [(1, c, n) for c, n in self.edges[1].items()])
        while queue:
            parent, c, node = queue.popleft()
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.edges[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.edges[at][c], popped
            queue.extend((node, x, n) for x, n in self.edges[node].items())
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Number of pieces of a word; 0 if it can't be split into pieces."""
        node, total = 0, 0
        for c in word:
            while c not in self.edges[node]:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 0
            node = self.edges[node][c]
        while node != 1:
            if node <= 0 or self.fail[node] < 0:
                return 0
            total += self.popped[node]
            node = self.fail[node]
        return total

    def counts(self, text: str) -> tuple[int, int, int]:
        """(words, pieces, unknown words) of a text; an unknown word is one piece."""
        words = pieces = unknown = 0
        for word, n in Counter(_WORD.findall(text)).items():
            k = self.cache.get(word)
            if k is None:
                if len(self.cache) >= _CACHE:
                    self.cache.clear()
                k = self.cache[word] = self.count(word)
            words += n
            pieces += n * (k or 1)
            unknown += n * (not k)
        return words, pieces, unknown


def pieces_of(model: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a sentencepiece file: a leading mark tells them apart; control and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return [x[1:] for x in names if x.startswith("▁") and len(x) > 1], [x for x in names if not x.startswith("▁")]


def token_counts(docs: DataFrame, initial: list[str], inner: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_words, n_pieces, n_unknown): one row per document.

    Words are runs of letters and digits, or single other marks. Null text is empty text: all counts 0. Repeated rows stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast((initial, inner))  # as large as the vocabulary
    state: list[Automaton] = []

    def run(batches):
        if not state:
            state.append(Automaton(*shared.value))
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            rows = [(len(t), *state[0].counts(t)) for t in texts]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_chars", "n_words", "n_pieces", "n_unknown"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, n_words long, n_pieces long, n_unknown long")
