"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is cut into pre-tokens (a run of non-space characters, with the white space
before it as the vocabulary's word mark). The distinct pre-tokens of a batch of texts
are inserted in a trie, level by level for all of them at once; the forward score of
a trie node, the best log probability of cutting the path to it into vocabulary
pieces, is computed once from its ancestors and shared by every pre-token that has
the prefix. The terminal node's number of pieces of the best cut is kept per
pre-token, and a text's count is the sum over its pre-tokens.

Pieces come from a public vocabulary file and are never trained. A piece at rank r
has log probability ``-log(r + 2)`` up to a constant that is the same for every piece
(Zipf's law by rank). A character that no piece covers costs one token per UTF-8
byte (byte fallback) at ``BYTE_COST`` each. Ties go to fewer pieces.

Each task counts its own texts, so nothing is shuffled. A trie holds at most
``max_words`` pre-tokens and the counts of at most ``max_known`` are kept for later
batches; that bounds memory and changes no result. Pre-tokens longer than LONG
characters share next to nothing and are scored one by one. Null and empty texts and
texts of white space have 0 tokens; null and repeated ids are counted row by row.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"  # the vocabulary's word mark
BYTE_COST = -14.0
LONG = 200


@lru_cache(2)
def pieces(path: str) -> dict[str, float]:
    """Piece -> score of a vocabulary file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            found[sp.id_to_piece(i)] = -math.log(len(found) + 2)
    return found


BIG = 1 << 21  # above every code point


class Trie:
    """Forward scores over a vocabulary. ``step`` is the vocabulary as a trie of
    reversed pieces, so one walk up from a node meets every piece that ends there."""

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        step: dict[tuple[int, int], int] = {}
        ends = {}
        for p, s in vocabulary.items():
            at = 0
            for c in reversed(p):
                at = step.setdefault((at, ord(c)), len(step) + 1)
            ends[at] = s
        keys = np.array([a * BIG + c for a, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(step.values()), np.int64)[order]
        self.piece = np.full(len(step) + 1, -np.inf)
        self.piece[list(ends)] = list(ends.values())

    def _follow(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states of the reversed pieces; -1: no piece goes on like this."""
        key = state * BIG + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of the best cut of each word."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        chars = np.frombuffer("".join([words[k] for k in order]).encode("utf-32-le", "surrogatepass"), np.int32)
        start = np.cumsum(size) - size
        room = len(chars) + 1
        parent, char = np.zeros(room, np.int32), np.zeros(room, np.int32)
        score, count = np.zeros(room), np.zeros(room, np.int32)
        node, used = np.zeros(len(words), np.int64), 1
        for depth in range(int(size[0])):
            n = int(np.searchsorted(-size, -depth, side="left"))  # words longer than depth
            key, inverse = np.unique(node[:n] * BIG + chars[start[:n] + depth], return_inverse=True)
            up, ch = key // BIG, key % BIG
            new = slice(used, used + len(key))
            node[:n] = used + inverse
            used += len(key)
            parent[new], char[new] = up, ch
            width = 1 + (ch > 0x7F) + (ch > 0x7FF) + (ch > 0xFFFF)
            best, pieces = score[up] + width * BYTE_COST, count[up] + width
            live, state = np.arange(len(key)), np.zeros(len(key), np.int64)
            while len(live):
                state = self._follow(state, ch)
                going = state >= 0
                live, state, up = live[going], state[going], up[going]
                s, c = self.piece[state] + score[up], count[up] + 1
                better = (s > best[live]) | ((s == best[live]) & (c < pieces[live]))
                best[live[better]], pieces[live[better]] = s[better], c[better]
                inside = up > 0
                live, state, up = live[inside], state[inside], up[inside]
                ch, up = char[up].astype(np.int64), parent[up].astype(np.int64)
            score[new], count[new] = best, pieces
        out = np.empty(len(words), np.int64)
        out[order] = count[node]
        return out

    def count(self, word: str) -> int:
        """The same for one (long) word."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode("utf-8", "surrogatepass"))
            s, n = best[-1]
            s, n = s + width * BYTE_COST, n + width
            for begin in range(max(0, end - self.longest), end):
                p = self.vocabulary.get(word[begin:end])
                if p is not None:
                    q, m = best[begin][0] + p, best[begin][1] + 1
                    if q > s or (q == s and m < n):
                        s, n = q, m
            best.append((s, n))
        return best[-1][1]


@lru_cache(2)
def trie_for(path: str) -> tuple[Trie, dict[str, int]]:
    """The vocabulary and the counts known so far, one of each per Python worker."""
    return Trie(pieces(path)), {}


def _count(path: str, max_words: int, max_known: int):
    def run(batches):
        trie, known = trie_for(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [t.split() if t else [] for t in part.column(1).to_pylist()]
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > max_known:
                    known.clear()
                    new = list(set().union(*texts))
                short = [w for w in new if len(w) <= LONG]
                for k in range(0, len(short), max_words):
                    some = short[k:k + max_words]
                    known.update(zip(some, trie.counts([MARK + w for w in some]).tolist()))
                known.update((w, trie.count(MARK + w)) for w in new if len(w) > LONG)
                get = known.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([sum(map(get, t)) for t in texts], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, max_words: int = 200_000, max_known: int = 1_000_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of ``docs(doc_id, text)``."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _count(vocabulary, max_words, max_known), f"doc_id {kind}, n_pretokens long, n_tokens long")
