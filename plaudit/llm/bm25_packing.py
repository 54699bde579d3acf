"""Packing by lexical retrieval: a sharded BM25 index fills each seed's window.

Texts become token ids (a byte-level BPE vocabulary file, path given by the caller)
closed by the end id 0. Full windows of ``window`` ids at the start of a document are
sequences of their own; what remains of each document (its tail) is packed.

Tails are range-partitioned by a lexical key (the smallest hash among the text's
pairs of neighbouring ids, so texts that share much tend to meet) and the row, which
also splits any group of equal texts. Inside a partition, runs of ``shard_rows`` tails form a shard
with an inverted index of BM25 weights over token ids. The longest unused tail is the
seed and asks with all distinct ids of its whole document; its unused neighbours in
score order (ties: in the shard's order) fill the window whole where they fit, and the
best one left is cut to close it exactly (the rest of it stays in the shard).
What a shard can't fill goes on to the next shard; what a partition can't fill is cut
into sequences whose lengths are powers of two, which need no padding. So each id is
in exactly one piece and nothing is padded.

Null or empty text: the end id alone. Null and repeated ids are packed row by row.
"""

from __future__ import annotations

import base64
import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import written

END = (0).to_bytes(4, "little")
_JOINED_SPACES = re.compile(r"\s (?:\s|\Z)")
_SPACES_GO_ON = re.compile(r" (?:\s|\Z)")   # quicker; holds wherever the other does
SLICE_BYTES, PIECE_BYTES = 32_000_000, 2_000_000   # of text: encoded together, in one output batch


class Bpe:
    """Token ids of texts, as little-endian 32-bit bytes or arrays. Texts are cut before
    single spaces, where the vocabulary's pre-tokeniser cuts as well, and ``many`` encodes
    each distinct part of its texts once. Added tokens (of the vocabulary's .json file) have
    ids of their own; a text is cut at them first, the longest at each place."""

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.added = {t: i.to_bytes(4, "little") for t, i in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.size = 1 + max([*ranks.values(), *(added or {}).values()], default=0)
        self.spaced = np.zeros(self.size, bool)   # ids of tokens that begin with a space
        self.spaced[[r for t, r in ranks.items() if t[:1] == b" "]] = True

    def array(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def whole(self, text: str) -> bytes:
        return self.array(text).astype("<u4").tobytes() if text else b""

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[p] if p in self.added else self.whole(p) for p in self.cut.split(text))
        return self.whole(text)

    def _uncut(self, text: str) -> bool:
        """Whether a text holds an added token or a run of white space that may not be cut."""
        return any(t in text for t in self.added) or (
            _SPACES_GO_ON.search(text) is not None and _JOINED_SPACES.search(text) is not None)

    def _parts(self, parts: pa.Array) -> list[np.ndarray]:
        """Ids of distinct text parts, each behind a space, and where each part has how many.
        Parts with no white space at their ends are encoded as one text: there a token
        begins with a space just where a part begins."""
        plain = pc.and_(pc.equal(pc.utf8_trim_whitespace(parts), parts), pc.not_equal(parts, ""))
        one, plain = parts.filter(plain), plain.to_numpy(zero_copy_only=False)
        found, size, start = [np.empty(0, np.uint32)], np.zeros(len(parts), np.int64), np.empty(len(parts), np.int64)
        if len(one):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one), " ")[0].as_py()
            found = [self.array(" " + text)]
            start[plain] = at = np.flatnonzero(self.spaced[found[0]])
            size[plain] = np.diff(np.append(at, len(found[0])))
        odd = [self.array(" " + p) for p in parts.filter(pa.array(~plain)).to_pylist()]
        size[~plain] = more = np.array(list(map(len, odd)), np.int64)
        start[~plain] = len(found[0]) + np.cumsum(more) - more
        return [np.concatenate(found + odd), start, size]

    def many(self, texts: pa.Array):
        """Of runs of the texts (null: empty): their ids one after another, each text's closed
        by 0, and how many each has."""
        texts = texts.fill_null("")
        uncut = {i: t for i, t in enumerate(texts.to_pylist()) if self._uncut(t)}
        if uncut:
            on = np.ones(len(texts), bool)
            on[list(uncut)] = False
            texts = pc.if_else(pa.array(on), texts, "")
        cut = pc.split_pattern(texts, " ")
        words = cut.flatten()
        first = cut.offsets.to_numpy()[:-1].astype(np.int64) - cut.offsets[0].as_py()
        rest = np.ones(len(words), bool)
        rest[first] = False
        heads = words.take(pa.array(first)).dictionary_encode()
        others = words.filter(pa.array(rest)).dictionary_encode()
        ids, start, size = self._parts(others.dictionary)
        own = [*map(self.array, heads.dictionary.to_pylist()),
               *[np.frombuffer(self.ids(t), "<u4") for t in uncut.values()], np.zeros(1, np.uint32)]
        own_size = np.array(list(map(len, own)), np.int64)
        start = np.concatenate([start, len(ids) + np.cumsum(own_size) - own_size])
        size = np.concatenate([size, own_size])
        ids = np.concatenate([ids, *own])
        # the parts of all texts in order: a text's head, its other parts, the end id
        ends = np.append(first[1:], len(words)) + np.arange(len(texts))
        begins = first + np.arange(len(texts))
        order = np.empty(len(words) + len(texts), np.int32)
        body = np.ones(len(order), bool)
        body[ends] = body[begins] = False
        order[body] = others.indices.to_numpy()
        head = heads.indices.to_numpy().copy()
        head[list(uncut)] = len(heads.dictionary) + np.arange(len(uncut))
        order[begins] = len(others.dictionary) + head
        order[ends] = len(size) - 1
        del cut, words, rest, body, others, heads
        for a, rows in _slices(texts, PIECE_BYTES, 500):
            own = order[begins[a]:ends[a + rows - 1] + 1]
            sizes = size[own]
            at = np.repeat(start[own] - (np.cumsum(sizes) - sizes), sizes)
            at += np.arange(len(at))
            yield ids[at], np.add.reduceat(sizes, begins[a:a + rows] - begins[a])


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a vocabulary's .json file and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in tokens if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd:
        raise ValueError(f"added tokens that take in what is around them: {odd}")
    return {t["content"]: int(t["id"]) for t in tokens}


@lru_cache(2)
def bpe(path: str, added: str | None = None) -> Bpe:
    return Bpe(path, added_tokens(added) if added else None)


def lexical_keys(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of texts with ``n`` ids each: the smallest 63-bit hash among the pairs of a text's
    neighbouring ids (a lone id: its own)."""
    x = ids.astype(np.uint64)
    ends = np.cumsum(n) - 1
    alone = x[ends[n == 1]]
    x[:-1] = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
    x[ends[n == 1]] = alone
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x[ends[n > 1]] = np.uint64(0xFFFFFFFFFFFFFFFF)   # reaches into the next text
    return (np.minimum.reduceat(x, ends - n + 1) >> np.uint64(1)).astype(np.int64)


def distinct_ids(ids: np.ndarray, seen: np.ndarray) -> bytes:
    """Distinct ids of a text in order. ``seen``: a false flag per id, false again after."""
    seen[ids] = True
    got = np.flatnonzero(seen)
    seen[ids] = False
    return got.astype("<u4").tobytes()


def _slices(texts: pa.Array, size: int, most: int):
    """(first row, rows) of runs of about ``size`` bytes of text, one to ``most`` rows."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(upto):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))
        end = min(max(end, at + 1), at + most)
        yield at, end - at
        at = end


def _tokenize(path: str, added: str | None, window: int):
    def run(batches):
        enc = bpe(path, added)
        seen = np.zeros(enc.size, bool)
        base, row, fulls = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            for at, rows in _slices(batch.column(1), SLICE_BYTES, batch.num_rows):
                part = batch.slice(at, rows)
                for ids, n in enc.many(part.column(1)):
                    ends, full = np.cumsum(n), n // window
                    terms = [distinct_ids(ids[e - k:e], seen) if k > window and k % window else None
                             for e, k in zip(ends.tolist(), n.tolist())]
                    whole = pa.Array.from_buffers(pa.binary(), len(n), [
                        None, pa.py_buffer((np.append(0, ends) * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(n)), pa.array(base + row + np.arange(len(n))), pa.array(n),
                         pa.array(lexical_keys(ids, n)), pa.array(base + fulls + np.cumsum(full) - full),
                         pa.array(terms, pa.binary()), whole],
                        ["doc_id", "row_id", "doc_tokens", "key", "first_full", "terms", "ids"])
                    at, row, fulls = at + len(n), row + len(n), fulls + int(full.sum())
    return run


class Shard:
    """BM25 inverted index of a run of tails: postings sorted by term. ``asked`` has the
    distinct ids that a tail's seed asks with where they are not the tail's own (those of
    its whole document), else None."""

    def __init__(self, tails: list[np.ndarray], asked: list[np.ndarray | None] | None = None,
                 k1: float = 1.2, b: float = 0.75):
        n = len(tails)
        lens = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(n), lens)
        self.vocabulary, term = np.unique(np.concatenate(tails), return_inverse=True)
        cell, tf = np.unique(term * np.int64(n) + doc, return_counts=True)
        self.doc = cell % n
        of = cell // n
        df = np.bincount(of, minlength=len(self.vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lens / lens.mean())
        self.weight = idf[of] * tf * (k1 + 1) / (tf + norm[self.doc])
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms = of[by_doc]
        self.ends = np.cumsum(np.bincount(self.doc, minlength=n))
        self.asked = asked
        self.n = self.live = n
        self._index(of)

    def _index(self, of: np.ndarray):
        self.of = of
        self.start = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(self.vocabulary)))))

    def drop_used(self, left: np.ndarray):
        """Take the postings of used tails out once a quarter of the tails is used."""
        live = int(np.count_nonzero(left))
        if live <= 0.75 * self.live:
            keep = left[self.doc] > 0
            self.doc, self.weight, self.live = self.doc[keep], self.weight[keep], live
            self._index(self.of[keep])

    def query(self, d: int) -> np.ndarray:
        """Distinct terms of the document of tail ``d`` that some tail holds."""
        if self.asked is None or self.asked[d] is None:
            return self.terms[self.ends[d - 1] if d else 0:self.ends[d]]
        at = np.searchsorted(self.vocabulary, self.asked[d])
        at[at == len(self.vocabulary)] = 0
        return at[self.vocabulary[at] == self.asked[d]]

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every tail for the terms of the document of tail ``d``."""
        t = self.query(d)
        a, size = self.start[t], self.start[t + 1] - self.start[t]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(sizes: list[int], shard: Shard | None, window: int):
    """Sequences of (row, from, to) parts that fill ``window`` exactly, and what is
    left of each row. ``sizes``: ids of each tail. A seed's unused neighbours are tried
    whole from the best to the worst, all of them; the best that is left is cut."""
    left = np.array(sizes, np.int64)
    done = np.zeros(len(sizes), np.int64)
    out = []
    total = int(left.sum())
    heap = np.argsort(-left, kind="stable").tolist()[::-1]
    while total >= window:
        while not left[heap[-1]]:
            heap.pop()
        seed = heap.pop()
        seq, room = [], window

        def take(d: int, n: int):
            seq.append((d, int(done[d]), int(done[d] + n)))
            done[d] += n
            left[d] -= n

        n = int(min(left[seed], room))
        take(seed, n)
        room -= n
        if left[seed]:
            heap.append(seed)
        if room:
            shard.drop_used(left)
            usable = np.flatnonzero(left)
            usable = usable[usable != seed]
            score, size = shard.scores(seed)[usable], left[usable]
            while room and len(fits := np.flatnonzero((size > 0) & (size <= room))):
                best = fits[score[fits].argmax()]
                take(int(usable[best]), int(size[best]))
                room -= int(size[best])
                size[best] = 0
            if room:  # none fits whole any more: cut the best
                on = np.flatnonzero(size)
                take(int(usable[on[score[on].argmax()]]), room)
        out.append(seq)
        total -= window
    return out, done, left


def _pack(window: int, shard_rows: int):
    def run(batches):
        base, count = TaskContext.get().partitionId() << 33, 0
        # a tail in hand: doc_id, ids of the whole document before it, its ids, doc_tokens, terms
        held: list[list] = []

        def emit(seqs, tails):
            nonlocal count
            cols: list[list] = [[] for _ in range(7)]
            for seq in seqs:
                at = 0
                for d, a, b in seq:
                    doc_id, start, ids, tokens, _ = tails[d]
                    for c, v in zip(cols, (doc_id, start + a, b - a, tokens, 2 * (base + count), at,
                                           ids[a:b].tobytes())):
                        c.append(v)
                    at += b - a
                count += 1
            kinds = [doc_type[0], *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def shard_of(tails, last):
            sizes = [len(t[2]) for t in tails]
            if sum(sizes) >= window:
                seqs, done, left = pack_shard(sizes, Shard([t[2] for t in tails], [t[4] for t in tails]), window)
                yield emit(seqs, tails)
                tails = [[d, s + int(a), ids[int(a):], n, t] for (d, s, ids, n, t), a in zip(tails, done) if a < len(ids)]
            if last and tails:
                seqs, cut, rest = [], [0] * len(tails), sum(len(t[2]) for t in tails)
                while rest:  # powers of two from the largest down
                    room = 1 << (rest.bit_length() - 1)
                    rest -= room
                    seq = []
                    for d, t in enumerate(tails):
                        n = min(room, len(t[2]) - cut[d])
                        if n:
                            seq.append((d, cut[d], cut[d] + n))
                            cut[d] += n
                            room -= n
                    seqs.append(seq)
                yield emit(seqs, tails)
                tails = []
            held[:] = tails

        doc_type = [pa.int64()]
        for batch in batches:
            doc_type[0] = batch.schema.field("doc_id").type
            cols = batch.select(["doc_id", "before", "doc_tokens", "tail", "terms"]).to_pydict()
            for d, s, n, t, q in zip(*cols.values()):
                held.append([d, s, np.frombuffer(t, "<u4"), n, None if q is None else np.frombuffer(q, "<u4")])
                if len(held) >= shard_rows:
                    yield from shard_of(list(held), False)
        if held:
            yield from shard_of(list(held), True)
    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, shard_rows: int = 1024,
         added: str | None = None) -> DataFrame:
    """Pieces doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit) of ``docs(doc_id, text)``. ``added``: path of the
    vocabulary's .json file with its added tokens (none without)."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    kind = dict(docs.dtypes)["doc_id"]
    toks = written(docs.select("doc_id", "text").mapInArrow(
        _tokenize(vocabulary, added, window),
        f"doc_id {kind}, row_id long, doc_tokens long, key long, first_full long, terms binary, ids binary"),
        "tokens", compression="zstd")
    cut = lambda at, n: F.substring("ids", at, n)
    rest = F.col("doc_tokens") % window
    tails = (toks.where(rest > 0)
             .select("doc_id", "row_id", "key", "doc_tokens", "terms", (F.col("doc_tokens") - rest).alias("before"),
                     F.expr(f"substring(ids, cast((doc_tokens - doc_tokens % {window}) * 4 + 1 as int), "
                            f"{window * 4})").alias("tail"))
             .repartitionByRange("key", "row_id").sortWithinPartitions("key", "row_id"))
    pieces = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = written(tails.mapInArrow(_pack(window, shard_rows), f"doc_id {kind}, {pieces}"), "pieces",
                     compression="zstd")
    full = (toks.where(F.col("doc_tokens") >= window)
            .select("doc_id", "doc_tokens", "first_full", "ids",
                    F.explode(F.expr(f"sequence(0L, doc_tokens div {window} - 1)")).alias("w"))
            .select("doc_id", (F.col("w") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                    "doc_tokens", ((F.col("first_full") + F.col("w")) * 2 + 1).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"),
                    F.expr(f"substring(ids, cast(w * {window * 4} + 1 as int), {window * 4})").alias("ids")))
    return full.unionByName(packed)


def padding(length: int, window: int = 1024) -> int:
    """Pad tokens of a sequence: none at the window or a power of two."""
    return 0 if length == window or length == 1 << int(math.log2(max(length, 1))) else window - length
