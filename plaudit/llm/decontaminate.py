"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Benchmark items and documents are sequences of word symbols (lower case, ASCII
punctuation taken as space; each character of a script without spaces is a word).
Item-sized windows of a document are embedded by the CGK
random walk: at step j the current symbol is copied out and the walk moves on to the
next symbol iff a random bit of (j, symbol) says so, so words after an edit fall back
into step and edit distance becomes Hamming distance. ``repeats`` independent walks
or more, each sampled at ``tables`` sets of ``bits`` positions, give the hash keys (an
item's length settles how many: as many as find ``recall`` of the copies with the most
edits allowed, by trial); a window
that shares a key with an item is a candidate, and the exact word edit distance of the
item to the best-fitting stretch of the window decides: contaminated if it is at most
``(1 - similarity) * words of the item``.

Only windows that can hold a match are embedded. Of an item of n words at most
d = floor((1 - similarity) * n) may be edited, so of any d + 1 of its words one is
left: a match lies around one of the item's d + 1 rarest words (anchors), starts at
most d words from where the anchor's place in the item says, starts with a word of the
items of that length, and has at least n - 2d such words. These tests lose nothing.

The benchmark is a stated query set: it is read in blocks of at most ``block_items``
items, and each block passes over all documents. Nothing is shuffled.

Null or empty texts match nothing; items of fewer than ``min_words`` words are
found where they stand without an edit; an item without words matches nothing. Null ids are kept in the result; repeated rows
give repeated rows; items of equal text are all reported.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PUNCT = bytes(b if (b >= 128 or chr(b).isalnum()) else 32 for b in range(256))
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


#: scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, ideographs
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_WIDE_PUNCT = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff1f]")


def words_of(text: str | None) -> list[bytes]:
    if text and not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _WIDE_PUNCT.sub(" ", text))
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT).split() if text else []


def scatter(x: np.ndarray) -> np.ndarray:
    x = (x + M1) * M2
    x ^= x >> np.uint64(31)
    x *= M1
    return x ^ (x >> np.uint64(29))


class Walks:
    """The walks' bits and sampled positions, the same wherever they are made; windows
    of all lengths go through them together."""

    def __init__(self, longest: int, repeats: int, tables: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.steps, self.repeats, self.tables = 2 * longest, repeats, tables
        # walks at half speed have not left a window of n words after 2 n steps
        self.at = rng.random((repeats, tables, bits))
        self.seeds = rng.integers(1, 2**63, (repeats, max(1, self.steps)), dtype=np.uint64)
        self.salt = rng.integers(1, 2**63, (repeats, tables), dtype=np.uint64)

    def keys(self, win: np.ndarray, size: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """(window, repeat * tables) keys of windows given as rows of symbols, of the
        repeats from ``first`` to ``last``; what is behind a window's ``size`` is -1."""
        n, last = len(win), self.repeats if last is None else last
        pad = np.concatenate([win, np.full((n, 1), -1, win.dtype)], 1)
        rows, out = np.arange(n), np.empty((n, (last - first) * self.tables), np.uint64)
        kind = scatter(size.astype(np.uint64))[:, None]
        for r in range(first, last):
            where, copied = np.zeros(n, np.int64), np.empty((n, self.steps), np.int64)
            for j in range(self.steps):
                s = copied[:, j] = pad[rows, where]
                go = scatter(s.view(np.uint64) ^ self.seeds[r, j]) & np.uint64(1)
                where = np.minimum(where + go.astype(np.int64), size)
            place = (self.at[r] * 2 * size[:, None, None]).astype(np.int64)
            seen = copied[rows[:, None, None], place].view(np.uint64)
            acc = kind ^ self.salt[r]
            for b in range(seen.shape[2]):
                acc = scatter(acc ^ seen[:, :, b] * M1)
            out[:, (r - first) * self.tables:(r - first + 1) * self.tables] = acc
        return out


def repeats_for(n: int, d: int, least: int, tables: int, bits: int, seed: int, recall: float,
                trials: int = 100, tried: int = 40) -> int:
    """Walks that find ``recall`` of the copies of ``n`` words with ``d`` edits (at least
    ``least``), from the walks that find each of ``trials`` made-up copies."""
    rng = np.random.default_rng(seed)
    text = np.arange(1, n + 1)
    win = np.full((trials, n), -1, np.int64)
    for k in range(trials):
        words = text.tolist()
        for e in range(d):
            kind, p = rng.integers(0, 3), int(rng.integers(0, len(words)))
            words[p:p + (kind != 1)] = [] if kind == 2 else [n + 1 + k * d + e]
        win[k, :len(words)] = words[:n]
    walks, size = Walks(n, tried, tables, bits, seed + 1), np.full(trials, n)
    same = walks.keys(win, size) == walks.keys(text[None, :], size[:1])
    found = same.reshape(trials, tried, tables).any(2).sum(1)
    missed = np.log1p(-(found + 0.5) / (tried + 1))  # of a walk; a copy that none found is not hopeless
    r = least
    while np.exp(r * missed).mean() > 1 - recall:
        r += 1
    return r


def fitting_distance(items: list[np.ndarray], stretches: list[np.ndarray]):
    """Smallest edit distance of each item to any part of its stretch, and the end of
    that part: dynamic programming over all pairs at once, free ends in the stretch."""
    n = len(items)
    ln = np.array([len(x) for x in items])
    width = max(len(x) for x in stretches)
    s = np.full((n, width), -2, np.int64)
    q = np.full((n, int(ln.max())), -3, np.int64)
    for k, (a, b) in enumerate(zip(items, stretches)):
        q[k, :len(a)] = a
        s[k, :len(b)] = b
    ramp = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    best, end = np.full(n, 1 << 30), np.zeros(n, np.int64)
    for i in range(q.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (s != q[:, i:i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        for k in np.flatnonzero(ln == i + 1):
            end[k] = int(row[k].argmin())
            best[k] = row[k, end[k]]
    return best, end


class Items:
    """A block of benchmark items: symbols, length classes, hash tables."""

    def __init__(self, rows: list[tuple], similarity: float, min_words: int, repeats: int, tables: int,
                 bits: int, seed: int, recall: float):
        self.similarity = similarity
        self.vocab: dict[bytes, int] = {}
        self.ids: list = []
        self.words: list[np.ndarray] = []
        for item_id, text in rows:
            w = words_of(text)
            if w:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.d = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        self.d[self.size < min_words] = 0
        self.longest = int(self.size.max(initial=0))
        # walks of a length: those of the next length of a grid
        grid = [1 << k for k in range(max(1, math.ceil(math.log2(max(self.longest, 2)))) + 1)]
        need = {n: repeats_for(n, math.floor((1 - similarity) * n + 1e-9), repeats, tables, bits, seed, recall)
                for n in grid if ((self.size <= n) & (2 * self.size > n)).any()}
        self.repeats = np.zeros(self.longest + 1, np.int64)
        for n, r in need.items():
            self.repeats[n // 2 + 1:n + 1] = r
        self.walks = Walks(self.longest, int(self.repeats.max()), tables, bits, seed)
        if not self.words:
            return
        wide = np.full((len(self.words), self.longest), -1, np.int64)
        for k, w in enumerate(self.words):
            wide[k, :len(w)] = w
        # words of the items of one length; the last row of symbols is the gap
        self.member = np.zeros((self.longest + 1, len(self.vocab) + 1), bool)
        for k, w in enumerate(self.words):
            self.member[self.size[k], w] = True
        spread = np.bincount(np.concatenate([np.unique(w) for w in self.words]), minlength=len(self.vocab) + 1)
        length = np.zeros(len(self.vocab) + 1, np.int64)
        for w, k in self.vocab.items():
            length[k] = len(w)
        anchors = []  # (symbol, item, place)
        for k, w in enumerate(self.words):
            for o in np.lexsort((-length[w], spread[w]))[:self.d[k] + 1]:
                anchors.append((w[o], k, o))
        anchors = np.array(sorted(anchors), np.int64)
        self.anchor_item, self.anchor_place = anchors[:, 1], anchors[:, 2]
        self.anchor_from = np.searchsorted(anchors[:, 0], np.arange(len(self.vocab) + 2))
        keys, row = [], []
        for some, got in self.keys(wide, self.size):
            keys.append(got.ravel())
            row.append(np.repeat(some, got.shape[1]))
        keys, row = np.concatenate(keys), np.concatenate(row)
        order = np.argsort(keys, kind="stable")
        self.flat, self.owner = keys[order], row[order]

    def keys(self, win: np.ndarray, size: np.ndarray):
        """(rows, their keys) of the walks that each row's length takes; keys are mixed
        with their table, for one sorted array of all tables."""
        first = 0
        for last in np.unique(self.repeats[size]).tolist():
            some = np.flatnonzero(self.repeats[size] >= last)
            got = self.walks.keys(win[some], size[some], first, last)
            yield some, scatter(got ^ (first * self.walks.tables + np.arange(1, got.shape[1] + 1)).astype(np.uint64))
            first = last

    def windows(self, sym: np.ndarray, gap: int) -> np.ndarray:
        """(size, start) of the windows that can hold a match."""
        count = np.diff(self.anchor_from)[sym]
        at = np.flatnonzero(count)
        n = count[at]
        entry = np.repeat(self.anchor_from[sym[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = self.anchor_item[entry]
        first = np.repeat(at, n) - self.anchor_place[entry] - self.d[item]
        wide = 2 * self.d[item] + 1
        step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        pairs = np.unique(np.repeat(self.size[item], wide) * np.int64(len(sym)) + np.repeat(first, wide) + step)
        size, start = pairs // len(sym), pairs % len(sym)
        good = (start < len(sym) - gap) & self.member[size, sym[start]]
        size, start = size[good], start[good]
        keep = []
        for k in range(0, len(size), 50_000):
            z, t = size[k:k + 50_000], start[k:k + 50_000]
            col = np.arange(self.longest)
            inside = self.member[z[:, None], sym[np.minimum(t[:, None] + col, len(sym) - 1)]] & (col < z[:, None])
            keep.append(inside.sum(1) >= z - 2 * np.floor((1 - self.similarity) * z + 1e-9))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return np.stack([size[keep], start[keep]], 1)

    def matches(self, sym: np.ndarray, gap: int):
        """(item index, distance, start, end) of every matching stretch of a symbol
        array; documents in it are kept apart by ``gap`` zeros."""
        out = []
        if not self.words:
            return out
        found = self.windows(sym, gap)
        col = np.arange(self.longest)
        for at in range(0, len(found), 5000):
            size, start = found[at:at + 5000].T
            win = np.where(col < size[:, None], sym[np.minimum(start[:, None] + col, len(sym) - 1)], -1)
            pairs = []
            for some, keys in self.keys(win, size):
                lo, hi = np.searchsorted(self.flat, keys, "left"), np.searchsorted(self.flat, keys, "right")
                w, t = np.nonzero(hi > lo)
                n = hi[w, t] - lo[w, t]
                entry = np.repeat(lo[w, t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs.append(np.stack([np.repeat(some[w], n), self.owner[entry]], 1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            for p in range(0, len(pairs), 2000):
                some = pairs[p:p + 2000]
                first, item = start[some[:, 0]], some[:, 1]
                left = np.maximum(0, first - self.d[item])
                dist, end = fitting_distance([self.words[k] for k in item], [
                    sym[a:b] for a, b in zip(left, first + self.size[item] + self.d[item])])
                out += [(int(k), int(x), int(s), int(a + e))
                        for k, x, s, a, e in zip(item, dist, first, left, end) if x <= self.d[k]]
        return out


def search(items: Items, texts: list) -> dict[tuple[int, int], tuple]:
    """(text, item) -> (distance, start word, end word) of the best window."""
    gap = 3 * items.longest + 1
    get = items.vocab.get
    out: dict[tuple[int, int], tuple] = {}
    for at in range(0, len(texts), 2000):
        syms, starts, size = [np.zeros(gap, np.int64)], [], gap
        for text in texts[at:at + 2000]:
            w = words_of(text)
            syms += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), np.zeros(gap, np.int64)]
            starts.append(size)
            size += len(w) + gap
        first = np.array(starts)
        for k, dist, start, end in items.matches(np.concatenate(syms), gap):
            doc = int(np.searchsorted(first, start, "right")) - 1
            now = (dist, start - starts[doc], end - starts[doc])
            if now < out.get((at + doc, k), (1 << 30,)):
                out[at + doc, k] = now
    return out


def _search(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            found = sorted(search(items, batch.column(1).to_pylist()).items())
            if found:
                doc, item, got = [d for (d, _), _ in found], [k for (_, k), _ in found], [x for _, x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())),
                     *(pa.array(v, pa.int64()) for v in (
                         [items.ids[k] for k in item], [x[0] for x in got], [len(items.words[k]) for k in item],
                         [x[1] for x in got], [x[2] for x in got]))],
                    ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])
    return run


def _clean(shared, text: int):
    def run(batches):
        for batch in batches:
            bad = {d for d, _ in search(shared.value, batch.column(text).to_pylist())}
            yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))
    return run


def item_blocks(benchmark: DataFrame, similarity: float = 0.8, min_words: int = 5, repeats: int = 12,
                tables: int = 4, bits: int = 3, block_items: int = 5000, seed: int = 5, recall: float = 0.99):
    """The benchmark's blocks, each broadcast; a block has about ``block_items`` items."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    blocks = max(1, math.ceil(items.count() / block_items))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()]  # one block of the query set
        yield sc.broadcast(Items(rows, similarity, min_words, repeats, tables, bits, seed, recall))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, distance, item_words, start_word, end_word (of the window that
    fits best): one row per document row and item that it holds. Options: see
    ``item_blocks``."""
    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, distance long, item_words long, "
              "start_word long, end_word long")
    out = None
    for block in item_blocks(benchmark, **options):
        got = docs.select("doc_id", "text").mapInArrow(_search(block), schema)
        out = got if out is None else out.unionByName(got)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    for block in item_blocks(benchmark, **options):
        docs = docs.mapInArrow(_clean(block, docs.columns.index("text")), docs.schema)
    return docs
