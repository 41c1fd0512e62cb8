"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is one trie with two roots, for pieces that begin a word and for those that go on.  Every node has a failure
link, to where the match goes on once the longest pieces of what was read are taken off, and the number of pieces taken off.
Reading a word follows one edge or link after the other and adds up those numbers, so that its length in pieces comes
without any piece being built, in time linear in the word.

Defined cases: a word that the vocabulary cannot spell counts as one unknown piece; a null or empty text has no words;
repeated rows and null ids come back as they are; an empty table gives an empty result.  Columns other than the named ones
are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from aislemetrics.llm.common import Memo, map_rows

UNKNOWN = 0


class Automaton:
    """``starts`` are the pieces that begin a word, ``goes_on`` those inside one; empty pieces are left out."""

    def __init__(self, starts: list[str], goes_on: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # the two roots
        ends = set()
        for root, pieces in ((0, starts), (1, goes_on)):
            for piece in pieces:
                node = root
                for sign in piece:
                    if sign not in self.next[node]:
                        self.next[node][sign] = len(self.next)
                        self.next.append({})
                    node = self.next[node][sign]
                if piece:
                    ends.add(node)
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for sign, child in self.next[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                link, count = self.fail[node], self.popped[node]
                while link >= 0 and sign not in self.next[link]:
                    count += self.popped[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[child], self.popped[child] = self.next[link][sign], count

    def pieces(self, word: str) -> int:
        """Number of greedy longest pieces of a word, ``UNKNOWN`` if it has none."""
        node, count = 0, 0
        for sign in word:
            while sign not in self.next[node]:
                if self.fail[node] < 0:
                    return UNKNOWN
                count += self.popped[node]
                node = self.fail[node]
            node = self.next[node][sign]
        while node != 1:
            if self.fail[node] < 0:
                return UNKNOWN
            count += self.popped[node]
            node = self.fail[node]
        return count


_loaded: dict[str, Automaton] = {}


def from_piece_model(path: str) -> Automaton:
    """Automaton over a piece model's vocabulary: pieces with one leading marker begin words, those without go on."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        plain = [piece for piece in pieces if "▁" not in piece]
        _loaded[path] = Automaton([piece[1:] for piece in pieces if piece[0] == "▁" and "▁" not in piece[1:]], plain)
    return _loaded[path]


def token_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row: words between ASCII white space, pieces with unknowns as one each."""

    def start():
        known = from_piece_model(model)
        lengths = Memo(lambda word: known.pieces(word.decode()))

        def work(texts):
            found = [[lengths[word] for word in (text or "").encode().split()] for text in texts]
            unknown = [counts.count(UNKNOWN) for counts in found]
            return [[len(counts) for counts in found], [sum(counts) + n for counts, n in zip(found, unknown)], unknown]

        return work

    return map_rows(docs, "n_words long, n_tokens long, n_unknown long", [text_col], start)
