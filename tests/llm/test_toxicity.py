import re
import time

import numpy as np
import pytest

from plaudit.llm import toxicity
from plaudit.llm.common import id_bucket


def swap_distance(a, b):
    """Edits between two words where a swap of two neighbours is one edit."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not (i and j)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_with_swaps_equals_distance(edits):
    rng = np.random.default_rng(edits)
    terms = {"".join(rng.choice(list("abc"), rng.integers(4, 9))): 1.0 for _ in range(40)}
    lex = toxicity.Lexicon(terms, edits, swaps=True)
    for _ in range(600):
        w = "".join(rng.choice(list("abc"), rng.integers(3, 10)))
        near = min((swap_distance(w, t), t) for t in terms)
        assert lex.find(w) == ((near[1], near[0]) if near[0] <= edits else None)


def plain_features(lexicon, text):
    """The features one place at a time, with the lines of the text looked at whole."""
    words = toxicity.tokens(text)
    hits = {w: m for w in set(words) if (m := lexicon.find(w))}
    if not hits:
        return [0.0] * len(toxicity.FEATURES)
    raw = text.lower()

    def quoted(w):
        states = []
        for line in raw.split("\n"):
            for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", line):
                before, after = line[:m.start()], line[m.end():]
                states.append((before.count('"') % 2 == 1 and '"' in after) or before.lstrip().startswith(">")
                              or any(before.rfind(o) > before.rfind(c) and c in after
                                     for o, c in (("“", "”"), ("«", "»"), ("„", "“"))))
        return bool(states) and all(states)

    sums = dict.fromkeys(toxicity.FEATURES, 0.0)
    for k, w in enumerate(words):
        if w not in hits:
            continue
        term, d = hits[w]
        weight = lexicon.terms[term]
        window = words[max(0, k - toxicity.WINDOW):k] + words[k + 1:k + 1 + toxicity.WINDOW]
        if quoted(w) or any(x in toxicity.REPORTING for x in window):
            sums["quoted"] += weight
            continue
        sums["all"] += weight
        if d:
            sums["near" if term in lexicon.frequent else "near_rare"] += weight
        sums["dense"] += weight * any(x in hits for x in window)
        sums["loud"] += weight * bool(re.search(rf"(?<!\w){re.escape(w)}\s*!", raw))
    sums["share"] = 200 * sums["all"] / len(words)
    return np.log1p(list(sums.values())).tolist()


def test_features_equal_plain_ones():
    rng = np.random.default_rng(3)
    lexicon = toxicity.Lexicon({"idiot": 1.0, "moron": 0.5, "scum": 0.25}, frequent=frozenset(["idiot"]), swaps=True)
    parts = ["idiot", "idoit", "morom", "scmu", "Moron!", "scum !", "garden", "river", "said", "word", '"', '"idiot"',
             "“", "”", "«", "»", "„", "\n", "\n> ", "_", "the", "of", "a"]
    for _ in range(400):
        text = " ".join(rng.choice(parts, rng.integers(0, 60)))
        assert np.allclose(toxicity.Scorer(lexicon).features(text), plain_features(lexicon, text)), text
    assert toxicity.Scorer(lexicon).features(None) == [0.0] * len(toxicity.FEATURES)


def test_many_hits_in_one_line_take_seconds():
    lexicon = toxicity.Lexicon({"idiot": 1.0}, swaps=True)
    text = 'you idiot "x" idoit! ' * 50_000
    began = time.time()
    got = toxicity.Scorer(lexicon).features(text)
    assert got[0] > 0 and time.time() - began < 8


def test_misspellings_of_rare_terms(spark):
    """Each of 30 terms stands in about 1 in 30 toxic texts; unseen texts misspell them."""
    rng = np.random.default_rng(5)
    letters = list("bcdfghjklmnprstvz")
    make = lambda n: "".join(c + v for c, v in zip(rng.choice(letters, n), rng.choice(list("aeiou"), n)))
    terms = sorted({make(k % 2 + 3) for k in range(30)})
    clean = [make(4) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(clean, 20))
    rows, labels = [], []
    for k in range(1500):
        rows.append((k, prose()))
        labels.append((k, 0))
    for k in range(900):
        rows.append((2000 + k, f"{prose()} {terms[k % len(terms)]} {prose()}"))
        labels.append((2000 + k, 1))
    wrong = []
    for k, t in enumerate(terms):
        cut = len(t) // 2
        wrong += [(5000 + 3 * k, t[:cut] + t[cut + 1:]), (5001 + 3 * k, t[:cut] + "x" + t[cut:]),
                  (5002 + 3 * k, t[:cut - 1] + t[cut] + t[cut - 1] + t[cut + 1:])]
    rows += [(i, f"{prose()} {w} {prose()}") for i, w in wrong] + [(9000 + k, prose()) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = id_bucket("doc_id", 5) == 9
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), held)
    lexicon = model.shared.value
    assert not lexicon.frequent and set(terms) <= set(lexicon.terms)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, held).collect()}
    assert np.mean([got[i] for i, _ in wrong]) >= 0.95
    assert np.mean([got[9000 + k] for k in range(200)]) <= 0.01
