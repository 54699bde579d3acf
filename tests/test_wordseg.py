"""Word discovery against plain counting, cutting against all possible cuts."""

import math
from collections import Counter

import pytest

from plaudit.operators import wordseg as ws

SENTENCES = ["我们喜欢游戏", "游戏很好玩", "我们玩游戏", "他们喜欢画面", "画面很好", "他们玩游戏", "喜欢游戏画面", "我们很好", "他们很好"]


def brute_statistics(texts, longest=4, least=5):
    grams, before, behind = Counter(), {}, {}
    for t in texts:
        for i in range(len(t)):
            for k in range(1, min(longest, len(t) - i) + 1):
                g = t[i:i + k]
                grams[g] += 1
                before.setdefault(g, Counter())[t[i - 1] if i else ("edge", grams[g])] += 1
                behind.setdefault(g, Counter())[t[i + k] if i + k < len(t) else ("edge", grams[g])] += 1
    total = sum(n for g, n in grams.items() if len(g) == 1)

    def entropy(c):
        return -sum(m / c.total() * math.log(m / c.total()) for m in c.values())
    return {g: (n, min(math.log(n * total / (grams[g[:k]] * grams[g[k:]])) for k in range(1, len(g))),
                min(entropy(before[g]), entropy(behind[g])))
            for g, n in grams.items() if len(g) > 1 and n >= least}


def test_statistics(spark):
    texts = SENTENCES * 3
    df = spark.createDataFrame([(f"{t} abc!",) for t in texts] + [(None,), ("",), ("latin only",)], "review string")
    got = {r["gram"]: (r["n"], r["cohesion"], r["freedom"]) for r in ws.word_statistics(df).collect()}
    want = brute_statistics(texts)
    assert {g for g in got if len(g) > 1} == set(want)
    for g, (n, c, f) in want.items():
        assert got[g][0] == n and got[g][1:] == pytest.approx((c, f), abs=1e-9)
    words = {r["word"] for r in ws.discover_words(ws.word_statistics(df)).collect()}
    assert {"游戏", "喜欢", "画面"} <= words and "欢游" not in words
    assert ws.word_statistics(df.where("false")).count() == 0


def all_cuts(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in all_cuts(run[k:]):
            yield [run[:k], *rest]


def test_most_probable_cut():
    counts = {"ab": 9, "bc": 7, "abc": 3, "c": 5, "a": 4, "cd": 2, "b": 1}
    cutter = ws.Cutter(counts)
    total = sum(counts.values())

    def cost(words):
        return sum(-math.log(counts[w] / total) if w in counts else math.log(total) if len(w) == 1 else math.inf
                   for w in words)
    for run in ("abcd", "abcabc", "dcba", "xabcx", "a", "bccdab", "zzz"):
        got = cutter.cut(run)
        assert "".join(got) == run and cost(got) == pytest.approx(min(map(cost, all_cuts(run))))


def test_segment(spark):
    words = spark.createDataFrame([("游戏", 10), ("喜欢", 8), ("我们", 9), ("的", 50)], "word string, n long")
    df = spark.createDataFrame([(1, "我们喜欢PC 游戏的!"), (2, None), (3, ""), (4, "游戏" * 20_000)], "k long, review string")
    got = {r["k"]: r["tokens"] for r in ws.segment(df, words, stop_words=["的"]).collect()}
    assert got[1] == ["我们", "喜欢", "pc", "游戏"] and got[2] == got[3] == [] and got[4] == ["游戏"] * 20_000
    none = ws.segment(df.where("k = 1"), words.where("false"), stop_words=[]).first()["tokens"]
    assert none == ["我", "们", "喜", "欢", "pc", "游", "戏", "的"]
