"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at the front of a word, then of
the rest, and so on. The automaton is a trie of the vocabulary in which each node has a
failure link: when no child fits the next character, the longest match of the node's
string is popped, and the link leads to the node of what is left of it. How many pieces
that pops is computed with the links, so a word is counted in one pass over its
characters, without building a piece or looking back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import table, whole
from facetry.llm.tokenids import TAIL, default_tokenizer, is_sure, spelled

#: Pieces of text remembered by one Python worker.
CACHE = 400_000
NONE = -1
#: A cached entry holds pieces, words and unknown words in one number.
FIELD = 40

_memory: dict[str, TextCounter] = {}


@dataclass
class Automaton:
    """Children by ``node << 21 | character``; failure links and popped pieces by node."""

    child: dict[int, int]
    fail: list[int]
    popped: list[int]
    start: int

    def count(self, word: str) -> int:
        """Pieces of a word, 0 for the empty one; ``NONE`` if the vocabulary can't spell it."""
        node, total, child, fail, popped = self.start, 0, self.child, self.fail, self.popped
        for c in map(ord, word):
            while (after := child.get(node << 21 | c)) is None:
                if fail[node] == NONE:
                    return NONE
                total += popped[node]
                node = fail[node]
            node = after
        while node != self.start and node != 0:
            if fail[node] == NONE:
                return NONE
            total += popped[node]
            node = fail[node]
        return total


def build(vocabulary: list[str], prefix: str = "") -> Automaton:
    """Automaton of a vocabulary; entries with ``prefix`` only continue words, the others only start them.

    Node 0 is where rest of a word starts. With an empty prefix words start there too.
    """
    child: dict[int, int] = {}
    is_piece, parent = [False], [(0, 0)]

    def new(of: int, c: int) -> int:
        is_piece.append(False)
        parent.append((of, c))
        return len(parent) - 1

    start = new(NONE, 0) if prefix else 0
    for piece in vocabulary:
        inside = bool(prefix) and piece.startswith(prefix)
        node, text = (0, piece[len(prefix) :]) if inside or not prefix else (start, piece)
        for c in map(ord, text):
            key = node << 21 | c
            if key not in child:
                child[key] = new(node, c)
            node = child[key]
        if text:
            is_piece[node] = True
    order: list[int] = []
    below: list[list[int]] = [[] for _ in parent]
    for node, (of, _) in enumerate(parent):
        if node not in (0, start):
            below[of].append(node)
    level = sorted({0, start})
    while level:
        level = [n for of in level for n in below[of]]
        order += level
    fail, popped = [NONE] * len(parent), [0] * len(parent)
    for node in order:
        of, c = parent[node]
        if is_piece[node]:
            fail[node], popped[node] = 0, 1
            continue
        at, total = fail[of], popped[of]
        while at != NONE and (after := child.get(at << 21 | c)) is None:
            total += popped[at]
            at = fail[at]
        if at != NONE:
            fail[node], popped[node] = after, total
    return Automaton(child, fail, popped, start)


class TextCounter:
    """Counts of whole texts: words as a tokenizer cuts them, their pieces by the automaton."""

    def __init__(self, path: str, automaton: Automaton):
        from tokenizers import Tokenizer

        self.tokenizer, self.automaton = Tokenizer.from_file(path), automaton
        self.known: dict[str, int] = {}

    def words(self, piece: str) -> list[str]:
        core = piece.rstrip(TAIL)
        tail = piece[len(core) :]
        if core and is_sure(core):
            return [spelled(core.lower()), tail] if tail else [spelled(core.lower())]
        clean = self.tokenizer.normalizer.normalize_str(piece)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]

    def _count(self, piece: str) -> int:
        total = 0
        for word in self.words(piece):
            n = self.automaton.count(word)
            total += (1 << FIELD) + (n if n != NONE else 1 + (1 << 2 * FIELD))
        return total

    def count(self, text: str) -> tuple[int, int, int]:
        """Words, pieces and unknown words; an unknown word counts as one piece."""
        pieces = text.replace("\n", " ").split(" ")
        known = self.known
        for p in pieces:
            if p not in known:
                if len(known) >= CACHE and len(pieces) < CACHE:
                    known.clear()
                    return self.count(text)
                known[p] = self._count(p) if p else 0
        total = sum(map(known.__getitem__, pieces))
        mask = (1 << FIELD) - 1
        return total >> FIELD & mask, total & mask, total >> 2 * FIELD


def vocabulary_of(path: str) -> list[str]:
    """Entries of a tokenizer file as plain strings: special tokens left out, marks of word ends dropped.

    A greedy match that had to end a word in a marked entry could run into a dead end.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    return sorted({p.removesuffix("</w>") for p in data["model"]["vocab"] if p not in special})


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_words, n_tokens, n_unknown`` per row, in one map pass.

    Null and empty texts have no words. Strings of special tokens are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(vocabulary_of(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _memory.get(tokenizer) or TextCounter(tokenizer, shared.value)
        _memory[tokenizer] = counter
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(key), whole(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_words long, n_tokens long, n_unknown long")


def op7_token_counts(spark, folder, tokenizer: str | None = None):
    """Words and greedy word pieces of every document."""
    return count_tokens(table(spark, folder, "documents"), tokenizer or default_tokenizer())
