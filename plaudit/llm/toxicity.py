"""Toxicity: Levenshtein automata over a learned lexicon trie, weighed by context.

The lexicon is learned from labelled texts: words (letters and digits, lower case)
that stand in toxic texts far more often than chance explains. Tokens are
matched by running the Levenshtein automaton of a token along the trie of all lexicon
terms, both at once, so a branch is left as soon as no term on it can be within
``max_edits``; two swapped neighbours are one edit. A match is weighed by its context window of ``WINDOW`` words on either
side: other matches and exclamation marks speak for abuse, quotation marks around the
word or a window of reporting words and quotes speak for quotation.

A logistic model over the resulting counts gives the score. It is fitted on a bounded
sample (``train_rows``, by id hash) of the labelled rows that the caller
allows for training; only texts are inputs. Tokens near a lexicon term that clean
training texts use are ordinary words, not misspellings. What is close to a rare term
is more often another word than what is close to a frequent one, so the model weighs
both apart, as what they differ from exact matches (with no misspelling among the
labelled texts they count like those); a training text's own words don't count as ordinary for it (the two halves
of the sample, by hash of the text, look each at the other's clean texts), or the model
would see no clean text with a near match at all.

Null and empty texts have no matches and score like any text without. Null and
repeated ids are scored row by row. Without a toxic or without a clean
training text the lexicon is empty and the score is the smoothed share of toxic
labels.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import hashed_sample, written

WINDOW = 8
FREQUENT = 0.1  # a term in this share of the toxic texts is a frequent one
CACHE_WORDS = 600_000
_STRIP = bytes(b if (b >= 128 or chr(b).isalnum()) else 32 for b in range(256))
#: fixed values: words that announce a quotation in the corpus languages
REPORTING = frozenset("said says wrote called quote quoted quoting word words term terms "
                      "dit disait mot mots cite sagte sagt schrieb wort worte zitat "
                      "dijo dice palabra palabras cita".split())
FEATURES = ("all", "near", "quoted", "dense", "loud", "share", "near_rare")


class Automaton:
    """Levenshtein automaton of a word: states are the reachable (position, errors)
    pairs with the fewest errors, kept as sorted tuples. With ``swaps`` two swapped
    neighbours are one edit; half a swap is a position below zero (~i: the letter after
    i has come, i is due)."""

    def __init__(self, word: str, max_edits: int, swaps: bool = False):
        self.word, self.max, self.swaps = word, max_edits, swaps

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.max, len(self.word)) + 1))

    def step(self, state: tuple, char: str) -> tuple:
        best: dict[int, int] = {}
        word, size = self.word, len(self.word)
        for i, e in state:
            if i < 0:
                moves = ((~i + 2, e),) if word[~i] == char else ()
            else:
                moves = ((i, e + 1), (i + 1, e + (i >= size or word[i] != char)))
                if self.swaps and i + 1 < size and word[i + 1] == char != word[i]:
                    moves += ((~i, e + 1),)
            for j, cost in moves:
                if cost <= self.max and j <= size and cost < best.get(j, self.max + 1):
                    best[j] = cost
        for i in sorted(k for k in best if k >= 0):  # letters of the word that are left out
            j, cost = i + 1, best[i] + 1
            while j <= size and cost <= self.max and cost < best.get(j, self.max + 1):
                best[j] = cost
                j, cost = j + 1, cost + 1
        return tuple(sorted(best.items()))

    def accepts(self, state: tuple) -> int | None:
        return min((e + len(self.word) - i for i, e in state
                    if i >= 0 and e + len(self.word) - i <= self.max), default=None)


class Lexicon:
    """Terms as a trie; ``find`` intersects it with a token's automaton. Terms of at
    least ``shortest`` letters match inexactly; ``frequent`` are the well supported ones."""

    def __init__(self, terms: dict[str, float], max_edits: int = 1, shortest: int = 4,
                 ordinary: frozenset = frozenset(), frequent: frozenset = frozenset(), swaps: bool = False):
        self.terms, self.max, self.shortest, self.ordinary = terms, max_edits, shortest, ordinary
        self.frequent, self.swaps = frequent, swaps
        self.root: dict = {}
        self.after, self.before, self.crossed = {}, {}, {}
        for term in terms:
            if len(term) < shortest:
                continue
            _insert(self.root, term, term)
            # one edit leaves the first or the second half of a term whole, so the rest
            # is looked for among the terms of that length with the same half; only a
            # swap over the middle touches both
            size, half = len(term), len(term) // 2
            _insert(self.after.setdefault((size, term[:half]), {}), term[half:], term)
            _insert(self.before.setdefault((size, term[half:]), {}), term[:half], term)
            swapped = term[:half - 1] + term[half] + term[half - 1] + term[half + 1:]
            self.crossed[swapped] = min(term, self.crossed.get(swapped, term))
        self.lengths = {n + k for n, _ in self.after for k in (-1, 0, 1)}

    def without(self, ordinary) -> Lexicon:
        """The same terms; ``ordinary`` words are no misspellings of them."""
        return Lexicon(self.terms, self.max, self.shortest, frozenset(ordinary), self.frequent, self.swaps)

    def find(self, token: str) -> tuple[str, int] | None:
        """The closest term (then the first by name) and its distance."""
        if token in self.terms:
            return token, 0
        n = len(token)
        if token in self.ordinary or (self.max == 1 and n not in self.lengths):
            return None
        if self.max > 1:
            found = self._walk(self.root, token) if n >= self.shortest - self.max else []
        else:
            found = [(1, self.crossed[token])] if self.swaps and token in self.crossed else []
            for size in (n - 1, n, n + 1):
                half = size // 2
                rest = self.after.get((size, token[:half]))
                if rest is not None:
                    found += self._walk(rest, token[half:])
                cut = max(0, n - (size - half))
                first = self.before.get((size, token[cut:]))
                if first is not None:
                    found += self._walk(first, token[:cut])
        if not found:
            return None
        d, term = min(found)
        return term, d

    def _walk(self, trie: dict, token: str) -> list[tuple[int, str]]:
        """(distance, term) of the trie's entries that the token's automaton accepts."""
        auto = Automaton(token, self.max, self.swaps)
        found = []
        stack = [(trie, auto.start())]
        while stack:
            at, state = stack.pop()
            for c, below in at.items():
                if not c:
                    d = auto.accepts(state)
                    if d is not None:
                        found.append((d, below))
                else:
                    new = auto.step(state, c)
                    if new:
                        stack.append((below, new))
        return found


def _insert(trie: dict, letters: str, term: str) -> None:
    for c in letters:
        trie = trie.setdefault(c, {})
    trie[""] = term


def tokens(text: str | None) -> list[str]:
    """Words of letters and digits, lower case."""
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_STRIP).decode("utf-8", "surrogatepass").split()


class Scorer:
    """Features of a text: sums over its matches, each weighed by its context."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def match(self, token: str):
        got = self.known.get(token, 0)
        if got == 0:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            got = self.known[token] = self.lexicon.find(token)
        return got

    def features(self, text: str | None) -> list[float]:
        words = tokens(text)
        hits = {w: m for w in set(words) if (m := self.match(w))}
        if not hits:
            return [0.0] * len(FEATURES)
        at = np.array([k for k, w in enumerate(words) if w in hits])
        quoted_words, loud_words = _marked(text.lower(), hits)
        said = np.concatenate([[0], np.cumsum([w in REPORTING for w in words])])
        low, high = np.maximum(at - WINDOW, 0), np.minimum(at + WINDOW + 1, len(words))
        own = said[at + 1] - said[at]
        report = said[high] - said[low] - own > 0
        close = np.searchsorted(at, at + WINDOW, "right") - np.searchsorted(at, at - WINDOW, "left") > 1
        frequent = self.lexicon.frequent
        kinds = {w: (self.lexicon.terms[t], d > 0 and t in frequent, d > 0 and t not in frequent,
                     w in quoted_words, w in loud_words) for w, (t, d) in hits.items()}
        weight, near, rare, quoted, loud = np.array([kinds[words[k]] for k in at], float).T
        quoted = (quoted > 0) | report
        meant = weight * ~quoted
        total = meant.sum()
        sums = [total, (meant * near).sum(), (weight * quoted).sum(), (meant * close).sum(), (meant * loud).sum(),
                200 * total / len(words), (meant * rare).sum()]
        return np.log1p(sums).tolist()


_RUN = re.compile(r"\w+")
_LOUD = re.compile(r"\s*!")
_BLANK = re.compile(r"\s*")


def _marked(raw: str, hits) -> tuple[set, set]:
    """The words of ``hits`` that stand between quotation marks at every place, and those
    that an exclamation mark follows somewhere. Quoted is a place with an odd number of
    straight marks before it in its line and one after it, or with an open typographic
    mark that closes in the line, or in a line that starts with ``>``. One pass over the
    words, with marks looked up by binary search."""
    places = {c: np.array([m.start() for m in re.finditer(re.escape(c), raw)] if c in raw else [], int)
              for c in '\n"“”«»„'}

    def below(c: str, x: int) -> int:
        return int(np.searchsorted(places[c], x))

    def last(c: str, x: int, start: int) -> int:
        k = below(c, x)
        return int(places[c][k - 1]) if k and places[c][k - 1] >= start else -1

    def follows(c: str, x: int, end: int) -> bool:
        k = below(c, x)
        return k < len(places[c]) and places[c][k] < end

    cited: dict[int, bool] = {}

    def in_quotes(s: int, e: int) -> bool:
        k = below("\n", s)
        a = int(places["\n"][k - 1]) + 1 if k else 0
        b = int(places["\n"][k]) if k < len(places["\n"]) else len(raw)
        if a not in cited:
            first = _BLANK.match(raw, a).end()
            cited[a] = first < b and raw[first] == ">"
        return (cited[a] or ((below('"', s) - below('"', a)) % 2 == 1 and follows('"', e, b))
                or any(last(o, s, a) > last(c, s, a) and follows(c, e, b)
                       for o, c in (("“", "”"), ("«", "»"), ("„", "“"))))

    found, bare, loud = set(), set(), set()
    plain = {w for w in hits if _RUN.fullmatch(w)}
    spans = ((m.group(), m.start(), m.end()) for m in _RUN.finditer(raw))
    odd = ((w, m.start(), m.end()) for w in hits if w not in plain
           for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", raw))
    for known, these in ((plain, spans), (hits, odd)):
        for w, s, e in these:
            if w not in known:
                continue
            found.add(w)
            if w not in bare and not in_quotes(s, e):
                bare.add(w)
            if w not in loud and _LOUD.match(raw, e):
                loud.add(w)
    return found - bare, loud


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights (intercept last) by Newton steps, with a pull to zero."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn_lexicon(words: list[tuple[str, int, int]], n_toxic: int, n_clean: int, n_words: int,
                  max_edits: int) -> Lexicon:
    """``words`` is (word, toxic texts, clean texts) of the over-represented ones among
    ``n_words`` words. Terms are words that chance does not explain: if labels were
    dealt at random, fewer than one word would be so one-sided. Their weight grows
    with the odds ratio. All of them match inexactly."""
    prior = n_toxic / max(1, n_toxic + n_clean)
    terms, frequent = {}, set()
    for w, t, c in words:
        chance = t * math.log(prior) + c * math.log(1 - prior) + sum(
            math.log((t + c - k) / (k + 1)) for k in range(min(t, c)))
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if chance + math.log(max(n_words, 1)) < 0 and odds > 1.5:
            terms[w] = min(odds, 6.0) / 6.0
            if t >= FREQUENT * n_toxic:
                frequent.add(w)
    return Lexicon(terms, max_edits, frequent=frozenset(frequent), swaps=True)


def _features(shared):
    """Features of training texts; ordinary are the words of the other half's clean texts."""
    def run(batches):
        lexicon, ordinary = shared.value
        scorers = [Scorer(lexicon.without(ordinary[1 - half])) for half in (0, 1)]
        for batch in batches:
            got = [scorers[half].features(t) for t, half in zip(batch.column(1).to_pylist(),
                                                                batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))],
                                             ["label", "x"])
    return run


def _ordinary(shared):
    """(half, w): tokens of clean texts that a lexicon term would take for misspellings."""
    def run(batches):
        lexicon = shared.value
        seen: set = set()
        for batch in batches:
            new = {(h, w) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                   for w in tokens(t)} - seen
            seen |= new
            near = [(h, w) for h, w in new if w not in lexicon.terms and lexicon.find(w)]
            if near:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in near], pa.int32()),
                                                  pa.array([w for _, w in near], pa.string())], ["half", "w"])
    return run


def _word_counts(batches):
    """(w, toxic texts, clean texts) of a task's words."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in set(tokens(text)):
                seen.setdefault(w, [0, 0])[1 - label] += 1
        if len(seen) > CACHE_WORDS:
            yield _counted(seen)
            seen.clear()
    yield _counted(seen)


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array([t for t, _ in seen.values()], pa.int64()),
         pa.array([c for _, c in seen.values()], pa.int64())], ["w", "t", "c"])


class Model:
    """A fitted scorer: lexicon (broadcast) and weights of the features."""

    def __init__(self, shared, weights: np.ndarray):
        self.shared, self.weights = shared, weights

    def scores(self, texts: list, scorer: Scorer) -> np.ndarray:
        x = np.array([scorer.features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _score(model: Model):
    def run(batches):
        scorer = Scorer(model.shared.value)
        for batch in batches:
            score = model.scores(batch.column(2).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()),
                 pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])
    return run


def _clean(model: Model, text: int):
    def run(batches):
        scorer = Scorer(model.shared.value)
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(text).to_pylist(), scorer) < 0.5))
    return run


def fit(docs: DataFrame, labels: DataFrame, held_out, train_rows: int = 20_000, max_edits: int = 1,
        max_terms: int = 2000) -> Model:
    """Learn from the rows of ``labels(doc_id, toxic)`` where ``held_out`` (a boolean
    column over doc_id) is not true. The lexicon keeps at most ``max_terms`` terms."""
    spark = docs.sparkSession
    usable = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
              .where(~F.coalesce(held_out, F.lit(False)))
              .groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("label")))
    chosen = hashed_sample(usable, F.xxhash64("doc_id"), train_rows, usable.count())  # bounded: safe to broadcast
    train = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "label", "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "toxicity_training")
    per = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = per.get(1, 0), per.get(0, 0)
    counts = written(train.mapInArrow(_word_counts, "w string, t long, c long").groupBy("w")
                     .agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity_words")
    words = counts.where((F.col("t") >= 2) & (F.col("t") > 3 * F.col("c"))).orderBy(F.desc("t"), "w") \
        .limit(max_terms).collect()
    lexicon = learn_lexicon([(r["w"], r["t"], r["c"]) for r in words] if n_clean and n_toxic else [], n_toxic,
                            n_clean, counts.count(), max_edits)
    first = spark.sparkContext.broadcast(lexicon)
    plain = train.where("label = 0").mapInArrow(_ordinary(first), "half int, w string").distinct().collect()
    ordinary = [frozenset(r["w"] for r in plain if r["half"] == half) for half in (0, 1)]  # few: near a term
    halves = spark.sparkContext.broadcast((lexicon, ordinary))
    shared = spark.sparkContext.broadcast(lexicon.without(ordinary[0] | ordinary[1]))
    sample = train.mapInArrow(_features(halves), "label int, x array<double>").collect()  # train_rows short rows
    x = np.array([r["x"] for r in sample], float).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in sample], float)
    return Model(shared, logistic(x, y) if len(y) else np.zeros(len(FEATURES) + 1))


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted of ``docs(doc_id, text)``."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(
        _score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below one half, all columns as they are."""
    return docs.mapInArrow(_clean(model, docs.columns.index("text")), docs.schema)
