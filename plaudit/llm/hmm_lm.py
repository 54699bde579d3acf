"""Hidden Markov language model over word classes, trained by Baum-Welch.

Words are ``[^\\x20\\x09-\\x0D]+`` runs after lower-casing A-Z; one end token closes
every text. A token's probability given the hidden state is
``p(class | state) * (c + 1) / (N_class + V_class + 1)``: the state chooses a class,
the class spells the word with add-one counts (one unseen type per class), so the
model is a proper distribution at any vocabulary size and only the class table is
ever held in memory. The ``own_classes`` most frequent words have a class each; the
others share ``suffix_classes`` classes by the hash of their last three bytes.

Passes over the corpus: (1) word counts, pre-aggregated per task and summed by
Spark; (2) class sequences, written once to the shared folder; (3) ``n_iter``
Baum-Welch iterations over all training sequences, each task emitting expected
counts that a grouped sum adds up (the driver only sees class x state numbers);
(4) the scaled forward recursion over every whole text. Counts of words beyond the
``head_words`` most frequent ones (whose table has that fixed bound) come from a
join with the whole count table.

Null text is an empty text (one end token). A null id counts as training data.
Repeated rows are scored row by row. Without training rows N = V = 0 and the model
is the uniform start model.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from plaudit.llm.common import written

END = b"\n"  # cannot be a word
END_CLASS = 0
CACHE_WORDS = 1_000_000  # a task's word caches start anew beyond this many entries


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _count_words(batches):
    """Word counts of a task in runs of bounded size (word, n)."""
    seen: Counter = Counter()

    def flush():
        keys = list(seen)
        for i in range(0, len(keys), 100_000):
            part = keys[i:i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([seen[k] for k in part], pa.int64())], ["w", "n"])
        seen.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words_of(text))
            seen[END] += 1
            if len(seen) > CACHE_WORDS:
                yield from flush()
    yield from flush()


class _Classes(dict):
    """word -> class, filled as words are met."""

    def __init__(self, own: dict[bytes, int], first: int, n: int):
        super().__init__(own)
        self.own, self.first, self.n = own, first, n

    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHE_WORDS + len(self.own):
            self.clear()
            self.update(self.own)
            if w in self:
                return self[w]
        c = self[w] = self.first + zlib.crc32(w[-3:]) % self.n
        return c


def _encoder(head, first: int, n_suffix: int):
    """head: broadcast of {word: (count, own class or -1)}."""
    def encode(batches):
        table = head.value
        classes = _Classes({w: k for w, (_, k) in table.items() if k >= 0}, first, n_suffix)
        logs = {w: math.log10(c + 1) for w, (c, _) in table.items()}
        base, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            cols = batch.to_pydict()
            out = {k: [] for k in ("row_id", "n_tokens", "head_log", "head_known", "cls", "rare")}
            for text in cols["text"]:
                toks = words_of(text)
                toks.append(END)
                got = [logs.get(w) for w in toks]
                rare = [w for w, x in zip(toks, got) if x is None]
                out["row_id"].append(base + row)
                row += 1
                out["n_tokens"].append(len(toks))
                out["head_log"].append(math.fsum(x for x in got if x is not None) if rare else math.fsum(got))
                out["head_known"].append(len(toks) - len(rare))
                out["cls"].append(np.fromiter(map(classes.__getitem__, toks), np.uint16, len(toks)).tobytes())
                out["rare"].append(rare)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["row_id"], pa.int64()), batch.column(batch.schema.get_field_index("doc_id")),
                 batch.column(batch.schema.get_field_index("held_out")), pa.array(out["n_tokens"], pa.int64()),
                 pa.array(out["head_log"], pa.float64()), pa.array(out["head_known"], pa.int64()),
                 pa.array(out["cls"], pa.binary()), pa.array(out["rare"], pa.list_(pa.binary()))],
                ["row_id", "doc_id", "held_out", "n_tokens", "head_log", "head_known", "cls", "rare"])
    return encode


def time_major(lengths: np.ndarray):
    """Sequences laid out step by step, longest first, without padding. Returns the
    order of the sequences, the tokens' places for a doc-major array, and the number
    of sequences still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    ln = lengths[order]
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    active = len(ln) - np.searchsorted(ln[::-1], np.arange(int(ln[0])), side="right")
    starts = np.concatenate(([0], np.cumsum(active)))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return order, starts[step] + rank[doc], starts, active


def forward(cls: np.ndarray, lengths: np.ndarray, model: dict) -> np.ndarray:
    """Natural-log likelihood of each class sequence by the scaled forward
    recursion (exact, double precision); ``cls`` holds the sequences end to end."""
    out = np.zeros(len(lengths))
    some = lengths > 0
    if not some.any():
        return out
    order, place, starts, active = time_major(lengths[some])
    seq = np.empty(len(cls), cls.dtype)
    seq[place] = cls
    emit, trans = model["emit"], model["trans"]
    total = np.zeros(len(order))
    a = None
    for t, n in enumerate(active):
        e = emit[seq[starts[t]:starts[t] + n]]
        a = model["init"] * e if a is None else (a[:n] @ trans) * e
        s = a.sum(1)
        a = a / s[:, None]
        total[:n] += np.log(s)
    back = np.empty(len(order))
    back[order] = total
    out[some] = back
    return out


def expected_counts(cls: np.ndarray, lengths: np.ndarray, model: dict):
    """One E step over sequences laid end to end: initial, transition and emission
    counts and the log likelihood."""
    order, place, starts, active = time_major(lengths)
    seq = np.empty(len(cls), cls.dtype)
    seq[place] = cls
    emit, trans, init = (model[k].astype(np.float32) for k in ("emit", "trans", "init"))
    k = len(init)
    obs = emit[seq]
    alpha = np.empty((len(seq), k), np.float32)
    scale = np.empty(len(seq), np.float32)
    for t, n in enumerate(active):
        at = slice(starts[t], starts[t] + n)
        a = init * obs[at] if t == 0 else (alpha[starts[t - 1]:starts[t - 1] + n] @ trans) * obs[at]
        s = a.sum(1)
        alpha[at] = a / s[:, None]
        scale[at] = s
    obs /= scale[:, None]
    beta = np.ones((len(seq), k), np.float32)
    back = trans.T.copy()
    move = np.zeros((k, k))
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        ob = obs[starts[t + 1]:starts[t + 1] + n] * beta[starts[t + 1]:starts[t + 1] + n]
        beta[starts[t]:starts[t] + n] = ob @ back
        move += alpha[starts[t]:starts[t] + n].T @ ob
    alpha *= beta
    size = emit.shape[0]
    em = np.stack([np.bincount(seq, weights=alpha[:, s], minlength=size) for s in range(k)], 1)
    return alpha[:active[0]].sum(0).astype(float), move * trans, em, float(np.log(scale.astype(float)).sum())


def windows(cls: np.ndarray, lengths: np.ndarray, size: int):
    """Cut sequences into windows of at most ``size`` tokens (for training only)."""
    full, rest = np.divmod(lengths, size)
    n = full + (rest > 0)
    ends = np.repeat(np.cumsum(n), n) - 1
    out = np.full(int(n.sum()), size, np.int64)
    last = np.arange(len(out)) == ends
    out[last] = np.where(rest > 0, rest, size)[n > 0].repeat(n[n > 0])[last]
    return out


def _estep(model: dict, window: int, block: int):
    k = len(model["init"])

    def run(batches):
        init, move, em, ll, n = np.zeros(k), np.zeros((k, k)), np.zeros(model["emit"].shape), 0.0, 0
        for batch in batches:
            seqs = [np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]
            cls = np.concatenate(seqs)
            lens = windows(cls, np.array([len(x) for x in seqs], np.int64), window)
            ends = np.cumsum(lens)
            at = 0
            while at < len(lens):
                start = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, start + block, side="right")))
                i, m, e, x = expected_counts(cls[start:ends[to - 1]], lens[at:to], model)
                init, move, em, ll, n = init + i, move + m, em + e, ll + x, n + int(ends[to - 1] - start)
                at = to
        met = np.flatnonzero(em.any(1))
        ids = np.concatenate([met, [-1], -2 - np.arange(k), [-2 - k]])
        vals = np.concatenate([em[met], init[None], move, [[ll, n] + [0.0] * (k - 2)]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(vals[:, s], pa.float64()) for s in range(k))],
            ["idx", *(f"g{s}" for s in range(k))])
    return run


def start_model(mass: np.ndarray, states: int, seed: int = 7, stay: float = 0.95) -> dict:
    """Class frequencies shaken per state; states tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (mass[:, None] + 1e-9) * np.exp(rng.normal(0, 0.7, (len(mass), states)))
    trans = np.full((states, states), (1 - stay) / (states - 1))
    np.fill_diagonal(trans, stay)
    return {"emit": emit / emit.sum(0), "trans": trans, "init": np.full(states, 1 / states)}


def m_step(rows: list, mass: np.ndarray, states: int, smooth: float = 50.0) -> tuple[dict, float]:
    """New parameters from summed counts; emissions are smoothed towards the class
    frequencies with ``smooth`` pseudo-tokens per state."""
    emit = np.zeros((len(mass), states))
    trans, init, ll, n = np.zeros((states, states)), np.zeros(states), 0.0, 0.0
    for r in rows:
        v = np.array([r[f"g{s}"] for s in range(states)])
        if r["idx"] >= 0:
            emit[r["idx"]] = v
        elif r["idx"] == -1:
            init = v
        elif r["idx"] == -2 - states:
            ll, n = v[0], v[1]
        else:
            trans[-2 - r["idx"]] = v
    emit += smooth * mass[:, None]
    trans += 0.1
    init += 0.1
    return {"emit": emit / emit.sum(0), "trans": trans / trans.sum(1, keepdims=True),
            "init": init / init.sum()}, ll / max(n, 1)


def _scorer(model: dict, class_log: np.ndarray):
    def run(batches):
        for batch in batches:
            seqs = [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
            lens = np.array([len(x) for x in seqs], np.int64)
            cls = np.concatenate(seqs)
            ll = forward(cls, lens, model) / math.log(10)
            ends = np.cumsum(lens)
            spell = np.concatenate(([0.0], np.cumsum(class_log[cls])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ll - (spell[ends] - spell[ends - lens]), pa.float64())],
                ["row_id", "hmm_log"])
    return run


def score_texts(docs: DataFrame, held_out, states: int = 8, n_iter: int = 5, own_classes: int = 4096,
                suffix_classes: int = 4096, head_words: int = 65_536, window: int = 256,
                block: int = 400_000) -> DataFrame:
    """Train on the rows where ``held_out`` (a boolean column) is not true and score
    all rows of ``docs(doc_id, text)``; returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = written(rows.where("not held_out").select("text").mapInArrow(_count_words, "w binary, n long")
                     .groupBy("w").agg(F.sum("n").alias("c")), "words")
    n_train, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the most frequent words: whole steps of an eighth of a doubling, as many as fit
    step = F.floor(F.log2("c") * 8)
    least, room = None, head_words
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):  # at most 8 rows a doubling
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    head = {} if least is None else {
        bytes(r["w"]): r["c"] for r in counts.where(step >= least).collect()}  # bounded by head_words
    head.update({bytes(r["w"]): r["c"] for r in counts.where(F.col("w") == F.lit(END)).collect()})
    frequent = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))[:own_classes]
    own = {w: i + 1 for i, w in enumerate(frequent)}
    own[END] = END_CLASS
    head.setdefault(END, 0)
    first, size = own_classes + 1, own_classes + 1 + suffix_classes
    shared = spark.sparkContext.broadcast({w: (c, own.get(w, -1)) for w, c in head.items()})

    # tokens and types of each class: own classes from the head, the rest by a grouped sum
    tok, typ = np.zeros(size), np.zeros(size)
    for w, k in own.items():
        tok[k], typ[k] = head[w], 1
    suffix = F.lit(first) + F.crc32(F.expr("substring(w, greatest(length(w) - 2, 1), 3)")) % suffix_classes
    own_frame = spark.createDataFrame([(bytearray(w),) for w in own], "w binary")
    for r in counts.join(F.broadcast(own_frame), "w", "left_anti").groupBy(suffix.alias("k")) \
            .agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most suffix_classes rows
        tok[r["k"]], typ[r["k"]] = r["n"], r["v"]
    mass = (tok + 1) / (tok + 1).sum()
    class_log = np.log10(tok + typ + 1)

    enc = written(rows.mapInArrow(
        _encoder(shared, first, suffix_classes),
        f"row_id long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, head_log double, "
        "head_known long, cls binary, rare array<binary>"), "classes")
    model = start_model(mass, states)
    train = enc.where("not held_out").select("cls")
    schema = "idx long, " + ", ".join(f"g{s} double" for s in range(states))
    for _ in range(n_iter):
        got = train.mapInArrow(_estep(model, window, block), schema).groupBy("idx") \
            .agg(*(F.sum(f"g{s}").alias(f"g{s}") for s in range(states))).collect()  # classes + states rows
        if not any(r["idx"] >= 0 for r in got):
            break
        model, _ = m_step(got, mass, states)

    rare = (enc.select("row_id", F.explode("rare").alias("w")).join(counts, "w")
            .groupBy("row_id").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log"),
                                   F.count("*").alias("rare_known")))
    hmm = enc.select("row_id", "cls").mapInArrow(_scorer(model, class_log), "row_id long, hmm_log double")
    log_sum = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    head_known = F.col("head_known") if n_train else F.lit(0)
    return (enc.drop("cls", "rare").join(hmm, "row_id").join(rare, "row_id", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (head_known + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(n_train).cast("long").alias("train_tokens"),
                    (log_sum - F.col("n_tokens") * math.log10(n_train + n_types + 1)).alias("base_score"),
                    (F.col("hmm_log") + log_sum).alias("score")))
