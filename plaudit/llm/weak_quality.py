"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every text (-1 low, 0 abstain, 1 high). The
number of texts with each vote pattern (at most 3 to the number of labellers) is a
grouped count over all documents; expectation-maximisation on that table estimates,
without any given label, the share of good texts and, for each labeller that does not
abstain, how often it votes low on low and on high texts, and so the posterior of a
pattern. Weak prior counts say that low votes are rare on high texts. The posteriors of a
bounded sample of texts (``train_rows`` by hash, one of each text)
train a linear scorer over hashed words, hashed word shapes and hashed steps of the
text's measures; it scores every whole text.

Null and empty texts get no votes and score by the scorer's intercept alone, as do
texts of white space. Null and repeated ids are scored row by row.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import hashed_sample

#: fixed values: frequent function words of the corpus languages
FUNCTION_WORDS = frozenset(
    "the of and to in is it that for was on are as with be this from "
    "la le les de des et un une du que est pas pour dans qui "
    "der die das und ist von den nicht ein eine sich mit dem "
    "el los las en es por con se del para".split())
_FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)
SYMBOLS = b"#$%&*+<=>@^`{|}~\\"
MARKS = b".,;:?"
LABELLERS = ("symbols", "capitals", "variety", "lines", "function_words", "marks", "word_length", "plain_words",
             "stutter")
BUCKETS = 1 << 16
CACHE_WORDS = 600_000
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()) + b"'-"
_AROUND_WORDS = b".,;:!?()\"'"
_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"))


class _Kinds(dict):
    """word -> 1 for a function word, plus 2 ** 32 for a word of letters and digits."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        got = self[w] = (w.lower() in _FUNCTION_BYTES) + (
            (w.strip(_AROUND_WORDS).translate(None, _LETTERS) == b"") << 32)
        return got


@lru_cache(1)
def kinds() -> _Kinds:
    return _Kinds()


def measures(text: bytes | None, words: list[bytes]) -> dict[str, float]:
    """What the labellers look at (empty without words)."""
    n = len(words)
    if not n:
        return {}
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    known = sum(map(kinds().__getitem__, words))
    return {"symbols": (size - len(text.translate(None, SYMBOLS))) / size,
            "capitals": (size - len(text.translate(None, _UPPER))) / size,
            "variety": len(set(words)) / n, "lines": 1 - len(set(lines)) / len(lines),
            "function_words": (known & 0xFFFFFFFF) / n,
            "marks": (size - len(text.translate(None, MARKS))) / n, "word_length": (size - n + 1) / n,
            "plain_words": (known >> 32) / n, "stutter": sum(map(bytes.__eq__, words[1:], words)) / n,
            "n_lines": len(lines)}


def votes(text: bytes | None) -> list[int]:
    """Each labeller's vote on a text."""
    words = text.split() if text else []
    return vote(measures(text, words), len(words))


def vote(m: dict[str, float], n: int) -> list[int]:
    if not n:
        return [0] * len(LABELLERS)
    pick = lambda low, high: -1 if low else 1 if high else 0
    return [pick(m["symbols"] > 0.04, m["symbols"] < 0.01), pick(m["capitals"] > 0.3, m["capitals"] < 0.1),
            pick(n >= 50 and m["variety"] < 0.25, n >= 20 and m["variety"] > 0.35),
            pick(m["lines"] > 0.3, m["n_lines"] > 2 and not m["lines"]),
            pick(n >= 20 and m["function_words"] < 0.02, m["function_words"] > 0.08),
            pick(n >= 20 and m["marks"] < 0.01, 0.02 < m["marks"] < 0.5),
            pick(m["word_length"] < 2 or m["word_length"] > 14, 3 < m["word_length"] < 10),
            pick(n >= 8 and m["plain_words"] < 0.75, m["plain_words"] > 0.9),
            pick(n >= 8 and m["stutter"] > 0.2, n >= 8 and m["stutter"] < 0.02)]


def _vote(batches):
    for batch in batches:
        got = [sum((v + 1) * 3 ** k for k, v in enumerate(votes(t))) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], ["pattern"])


def pattern_votes(pattern: np.ndarray) -> np.ndarray:
    """(pattern, labeller) -> vote + 1."""
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def label_model(pattern: np.ndarray, n: np.ndarray, rounds: int = 200, weight: float = 0.02) -> dict:
    """EM over vote patterns: share of high texts, each labeller's rates of low votes
    on (low, high) texts, and each pattern's posterior of a high text. ``weight``: the
    prior counts as a share of all texts."""
    if not len(pattern):
        return {"prior": 0.5, "low": np.tile([0.5, 0.03], (len(LABELLERS), 1)), "posterior": {}}
    v = pattern_votes(pattern)
    low, said = (v == 0).astype(float), (v != 1).astype(float)  # pattern, labeller
    start = np.array([0.5, 0.03])  # low votes on low and on high texts
    prior, rate, strength = 0.8, np.tile(start, (len(LABELLERS), 1)), weight * n.sum() + 1
    post = np.zeros(len(pattern))
    for _ in range(rounds):
        logs = np.stack([low @ np.log(rate[:, c]) + (said - low) @ np.log(1 - rate[:, c]) for c in (0, 1)], 1)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1] + np.log((1 - prior) / prior), -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
        for c, w in enumerate(((1 - post) * n, post * n)):
            rate[:, c] = (w @ low + strength * start[c]) / (w @ said + strength)
        prior = ((post * n).sum() + 0.8 * strength) / (n.sum() + strength)
    return {"prior": prior, "low": rate, "posterior": dict(zip(pattern.tolist(), post.tolist()))}


def shape(w: bytes) -> bytes:
    for pat, c in _SHAPES:
        w = pat.sub(c, w)
    return w


def buckets(w: bytes) -> tuple[int, int]:
    """Hashed word and hashed word shape (the upper half of the table)."""
    return zlib.crc32(w.lower()) % BUCKETS, BUCKETS + zlib.crc32(shape(w)) % BUCKETS


def whole_buckets(m: dict[str, float], n: int) -> list[int]:
    """Hashed features of a whole text: each measure and the length in steps."""
    steps = [f"{k}:{min(40, int(v * 40))}" if k not in ("word_length", "n_lines") else f"{k}:{int(np.log2(v + 1) * 2)}"
             for k, v in m.items()]
    steps.append(f"n:{n.bit_length()}")
    return [zlib.crc32(x.encode()) % BUCKETS for x in steps]


def _features(batches):
    """Pattern and hashed features (bucket, value) of sampled texts: each word and word
    shape with its share of the words, each feature of the whole text with 1."""
    for batch in batches:
        pat, idx, val = [], [], []
        for text in batch.column(0).to_pylist():
            words = text.split() if text else []
            m = measures(text, words)
            got, n = np.unique(np.array([b for w in words for b in buckets(w)], np.int32), return_counts=True)
            whole = np.array(whole_buckets(m, len(words)), np.int32) if words else np.empty(0, np.int32)
            pat.append(sum((v + 1) * 3 ** k for k, v in enumerate(vote(m, len(words)))))
            idx.append(np.concatenate([got, whole]).astype("<i4").tobytes())
            val.append(np.concatenate([n / max(len(words), 1), np.ones(len(whole))]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pat, pa.int64()), pa.array(idx, pa.binary()),
                                          pa.array(val, pa.binary())], ["pattern", "idx", "val"])


def fit_linear(idx: list[np.ndarray], val: list[np.ndarray], target: np.ndarray, rounds: int = 100,
               rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: full-batch AdaGrad over sparse rows."""
    w, b = np.zeros(2 * BUCKETS), 0.0
    if not len(target):
        return w, b
    size = np.array([len(x) for x in idx])
    row, col, x = np.repeat(np.arange(len(idx)), size), np.concatenate(idx), np.concatenate(val).astype(float)
    g2, gb2 = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights=w[col] * x, minlength=len(idx)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        g = np.bincount(col, weights=err[row] * x, minlength=len(w)) + decay * w
        gb = err.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        b -= 0.1 * rate * gb / np.sqrt(gb2)
    return w, b


class _Weights(dict):
    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        i, j = buckets(word)
        got = self[word] = float(self.w[i] + self.w[j])
        return got


def _scorer(shared, b: float, keep: float):
    def run(batches):
        weights = _Weights(shared.value)
        get = weights.__getitem__
        for batch in batches:
            score = []
            for text in batch.column(1).to_pylist():
                words = text.split() if text else []
                z = b
                if words:
                    z += sum(map(get, words)) / len(words) + sum(
                        weights.w[k] for k in whole_buckets(measures(text, words), len(words)))
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array([s >= keep for s in score], pa.bool_())],
                ["doc_id", "score", "keep"])
    return run


def quality(docs: DataFrame, train_rows: int = 6000, keep: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: better text), keep of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    table = texts.select("text").mapInArrow(_vote, "pattern long").groupBy("pattern").count().collect()
    model = label_model(np.array([r[0] for r in table], np.int64).reshape(-1),
                        np.array([r[1] for r in table], float).reshape(-1))  # at most 3 ** 9 rows
    sample = hashed_sample(texts, F.xxhash64(F.col("doc_id").cast("string"), "text"), train_rows,
                           sum(r[1] for r in table)).select("text").distinct() \
        .mapInArrow(_features, "pattern long, idx binary, val binary").collect()  # bounded by train_rows
    sample = [r for r in sample if r["idx"]]  # texts without words teach nothing
    w, b = fit_linear([np.frombuffer(r["idx"], "<i4") for r in sample], [np.frombuffer(r["val"], "<f4") for r in sample],
                      np.array([model["posterior"][r["pattern"]] for r in sample]))
    return texts.mapInArrow(_scorer(spark.sparkContext.broadcast(w), b, keep),
                            f"doc_id {kind}, score double, keep boolean")
