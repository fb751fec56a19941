"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a trie with two roots, one for the start of a word and one for what follows. Where a walk can't go on, a
node's failure link leads to the node that the rest of its text would be at once the longest pieces in front are cut off, and
the number of these pieces is stored with the link. So a word is counted in one pass, and no piece is ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridlark.llm.tables import local_path, slices

MARK = "▁"
_WORD = re.compile(r"\w+|[^\w\s]")


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that start a word and pieces that go on with one, from a sentence-piece file: its mark stands before starts.

    Single characters may stand in either place. Control, unknown and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    starts = {p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]}
    onward = {p for p in pieces if MARK not in p}
    return sorted(starts | {p for p in onward if len(p) == 1}), sorted(onward | {p for p in starts if len(p) == 1})


class Automaton:
    """``count(word)``: pieces that greedy longest-match-first cuts the word into, or None where it can't be cut."""

    def __init__(self, starts: Iterable[str], onward: Iterable[str]) -> None:
        self.go: list[dict[str, int]] = [{}, {}]  # node 0: start of a word, node 1: after a piece
        piece = [False, False]
        for root, pieces in ((0, starts), (1, onward)):
            for p in pieces:
                at = root
                for c in p:
                    if c not in self.go[at]:
                        self.go[at][c] = len(self.go)
                        self.go.append({})
                        piece.append(False)
                    at = self.go[at][c]
                piece[at] = True
        self.fail: list[int | None] = [None] * len(self.go)
        self.popped = [0] * len(self.go)
        queue = [0, 1]
        for u in queue:  # grows while it is walked: breadth first
            for c, v in self.go[u].items():
                queue.append(v)
                if piece[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, pops = self.fail[u], self.popped[u]
                while z is not None and c not in self.go[z]:
                    z, pops = self.fail[z], pops + self.popped[z]
                if z is not None:
                    self.fail[v], self.popped[v] = self.go[z][c], pops

    def count(self, word: str) -> int | None:
        go, fail, popped, u, n = self.go, self.fail, self.popped, 0, 0
        for c in word:
            while c not in go[u]:
                n += popped[u]
                u = fail[u]
                if u is None:
                    return None
            u = go[u][c]
        while u > 1:
            n += popped[u]
            u = fail[u]
            if u is None:
                return None
        return n


class Counter(dict):
    """(words, tokens, unknown words) of the chunks between blanks, remembered within bounds."""

    def __init__(self, automaton: Automaton, most: int = 500_000) -> None:
        self.automaton, self.most = automaton, most

    def __missing__(self, chunk: str) -> tuple[int, int, int]:
        counts = [self.automaton.count(w) for w in _WORD.findall(chunk)]
        out = len(counts), sum(1 if c is None else c for c in counts), sum(c is None for c in counts)
        if len(self) < self.most and len(chunk) < 64:
            self[chunk] = out
        return out

    def of(self, text: str | None) -> tuple[int, int, int]:
        found = list(map(self.__getitem__, (text or "").split()))
        return tuple(map(sum, zip(*found, strict=True))) if found else (0, 0, 0)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter for the vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Automaton(*vocabulary(path)))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row of ``docs`` (doc_id, text, others).

    A word is a run of letters, digits and low lines or one other sign; one that can't be cut is one (unknown) token,
    however long. Null and empty texts count 0. Repeated rows and null ids come out as they are. An empty table gives an
    empty result. ``path`` is the vocabulary's file; it must be at the same place on all machines.
    """
    path = path or local_path("piece_bpe_32k.model")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path).of
        for b in slices(batches):
            found = list(zip(*map(of, b.column(1).to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in found)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
