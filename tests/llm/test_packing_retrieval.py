"""Retrieval of the packing: BM25 of the whole document's terms, every neighbour tried."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from plaudit.llm import bm25_packing
from plaudit.llm.bm25_packing import Shard, bpe, lexical_keys, pack_shard


def _bm25(tails, asked, live, k1=1.2, b=0.75):
    """Scores by the formula, statistics over all tails."""
    n, mean = len(tails), sum(map(len, tails)) / len(tails)
    df = Counter(t for x in tails for t in set(x.tolist()))
    out = []
    for x, on in zip(tails, live):
        tf = Counter(x.tolist())
        out.append(sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1)
                       / (tf[t] + k1 * (1 - b + b * len(x) / mean)) for t in asked if t in tf) if on else 0.0)
    return np.array(out)


def _tails(seed, n=60):
    r = np.random.default_rng(seed)
    return [r.integers(0, 300, r.integers(1, 90)).astype(np.uint32) for _ in range(n)]


def test_scores_of_whole_documents_and_used_tails():
    tails = _tails(1)
    asked = [None] * 60
    asked[7] = np.unique(np.concatenate([tails[3], tails[7], np.array([100_000], np.uint32)]))
    shard = Shard(tails, asked)
    live = np.ones(60, np.int64)
    for d in (7, 8):
        want = asked[d].tolist() if asked[d] is not None else set(tails[d].tolist())
        np.testing.assert_allclose(shard.scores(d), _bm25(tails, want, live))
    live[10:40] = 0
    shard.drop_used(live)
    assert len(shard.doc) == sum(len(set(t.tolist())) for t, on in zip(tails, live) if on)
    np.testing.assert_allclose(shard.scores(7), _bm25(tails, asked[7].tolist(), live))


def test_short_tail_asks_with_its_document():
    """A tail of one id finds its document's topic."""
    topics = [np.arange(k * 100, k * 100 + 60, dtype=np.uint32) for k in range(5)]
    tails = [t for t in topics for _ in range(3)] + [np.array([9999], np.uint32)]
    asked = [None] * 15 + [np.concatenate([topics[4], [9999]]).astype(np.uint32)]
    assert set(np.argsort(-Shard(tails, asked).scores(15))[:3].tolist()) == {12, 13, 14}


def test_every_neighbour_is_tried_whole():
    """The greedy rule against a plain loop over all neighbours, more than 64 of them."""
    tails = _tails(2, 400)
    sizes, window = [len(t) for t in tails], 128
    got, done, left = pack_shard(sizes, Shard(tails), window)
    rest, at = list(sizes), [0] * len(sizes)
    heap = sorted(range(len(sizes)), key=lambda d: (-sizes[d], d))
    shard = Shard(tails)
    for seq in got:
        seed = next(d for d in heap if rest[d])
        room, want = window, []
        order = sorted((d for d in range(len(sizes)) if rest[d] and d != seed), key=lambda d: (-shard.scores(seed)[d], d)) \
            if rest[seed] < window else []
        for d in [seed, *order]:
            n = rest[d] if rest[d] <= room else (room if d == seed else 0)
            if n:
                want.append((d, at[d], at[d] + n))
                at[d], rest[d], room = at[d] + n, rest[d] - n, room - n
        if room:
            d = next(d for d in order if rest[d])
            want.append((d, at[d], at[d] + room))
            at[d], rest[d] = at[d] + room, rest[d] - room
        assert seq == want
        if rest[seed] == 0:
            heap.remove(seed)
    assert sum(rest) < window and rest == left.tolist() and at == done.tolist()


def _many(enc, texts):
    out = []
    for ids, n in enc.many(pa.array(texts, pa.string())):
        out += [(x.tolist(), k) for x, k in zip(np.split(ids, np.cumsum(n)[:-1]), lexical_keys(ids, n).tolist())]
    return out


def test_many_texts_have_the_ids_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    bits = [*"ab é's1.!\n\t　\x85\x1c✓<|  ", " ", "<|endoftext|>"]
    texts = [None, "", *["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(2000)]]
    enc = bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bm25_packing, "PIECE_BYTES", 500)
    got = _many(enc, texts)
    assert [x for x, _ in got] == [[*np.frombuffer(enc.ids(t or ""), "<u4").tolist(), 0] for t in texts]
    assert [k for x, k in got] == [_many(enc, [t])[0][1] for t in texts]


def test_distinct_parts_are_encoded_in_one_call(monkeypatch):
    """Not one call per distinct word: those were two thirds of the time of the packing."""
    enc = bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    calls, real = [], enc.array
    monkeypatch.setattr(enc, "array", lambda t: calls.append(t) or real(t))
    texts = [f"a word{i} and other{i * 7} words" for i in range(400)]
    assert len(_many(enc, texts)) == 400
    assert len(calls) == 2   # the texts' heads, which have no space, and all other parts
