"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


MARK = "▁"  # begins a piece that starts a word


class Automaton:
    """Greedy longest-match word-piece lengths in time linear in the word.

    A trie holds the pieces that start a word (from node 0) and those that continue one
    (from node 1). When a character has no edge, the node's failure link leads to the node
    for what remains after greedily popping pieces, and ``popped`` says how many pieces
    that pops: counts alone are kept, no piece is ever built.

    With ``whole`` every word has a length: the word mark alone is a piece, and a character
    that no piece begins with counts as its UTF-8 bytes, each a piece.
    """

    def __init__(self, first: Iterable[str], later: Iterable[str], whole: bool = False):
        if whole:
            first, later = list(first), list(later)
            lone = set("".join(first)).union(*later).difference(later)
            self.whole, worth = True, {c: len(c.encode()) for c in lone}
        else:
            self.whole, worth = False, {}
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, [*later, *worth])):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    at = self.edges[at][c]
                if piece:
                    ends[at] = True
        self.failure, self.popped = [-1] * len(ends), [0] * len(ends)
        if whole:
            self.failure[0] = self.popped[0] = 1
            for c in worth:
                self.popped[self.edges[1][c]] = worth[c]
        todo = deque([0, 1])
        while todo:
            v = todo.popleft()
            for c, u in self.edges[v].items():
                todo.append(u)
                if ends[u]:
                    self.failure[u], self.popped[u] = 1, self.popped[u] or 1
                    continue
                z, count = self.failure[v], self.popped[v]
                while z >= 0 and c not in self.edges[z]:
                    count += self.popped[z]
                    z = self.failure[z]
                if z >= 0:
                    self.failure[u], self.popped[u] = self.edges[z][c], count

    def length(self, word: str) -> int:
        """Number of pieces of a word that is not empty; 0 if greedy matching gets stuck."""
        edges, failure, popped = self.edges, self.failure, self.popped
        at = count = 0
        for c in word:
            while (to := edges[at].get(c, -1)) < 0:
                if failure[at] < 0:
                    break
                count += popped[at]
                at = failure[at]
            if to >= 0:
                at = to
            elif self.whole:
                count += len(c.encode())
            else:
                return 0
        while at != 1:
            if failure[at] < 0:
                return 0
            count += popped[at]
            at = failure[at]
        return count


def vocabulary(model_file: str) -> tuple[list[str], list[str]]:
    """The pieces of a SentencePiece model: those that start a word (without their mark) and
    those that continue one. Control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [p[1:] for p in pieces if p.startswith(MARK) and p != MARK], [p for p in pieces if MARK not in p]


def token_counts(docs: DataFrame, model_file: str, whole: bool = False) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row: greedy longest-match pieces of
    each word. A word that cannot be matched is one unknown token; with ``whole`` there is
    none: the word mark alone and the bytes of a character are pieces too.

    Null or empty text: all 0. A word is matched once per task, in a table of bounded size;
    repeated rows count alike. Very long words cost time linear in their length."""

    def run(batches):
        automaton = Automaton(*vocabulary(model_file), whole)
        known: dict[bytes, int] = {}
        for b in batches:
            rows: list[list[int]] = [[], [], []]
            for text in b.column(1):
                words = (text.as_py() or "").encode().split()
                if len(known) > 500_000:
                    known.clear()
                for w in set(words):
                    if w not in known:
                        known[w] = automaton.length(w.decode())
                counts = [known[w] for w in words]
                unknown = counts.count(0)
                for column, x in zip(rows, (len(words), sum(counts) + unknown, unknown), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in rows)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long"), "token-counts")
