"""Topics as a table: rising bound, the terms of Spark's model, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import lda
from plaudit.operators import topics as tp
from plaudit.operators.variational import INNER, SETTLED, trigamma

THEMES = [["sword", "dragon", "castle", "quest", "knight"], ["engine", "wheel", "brake", "track", "pedal"],
          ["piano", "violin", "chorus", "melody", "rhythm"]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(90):
        words = [THEMES[d % 3][i] for i in rng.integers(0, 5, 14)] + [THEMES[rng.integers(0, 3)][rng.integers(0, 5)]]
        rows.append((f"{d}" if d % 7 else None, " ".join(words), d % 2))
    return spark.createDataFrame(rows, "recommendation_id string, review string, voted_up int")


def themes(rows):
    found = {}
    for r in rows:
        found.setdefault(r["topic"], set()).add(r["term"])
    return sorted(map(sorted, found.values()))


def test_bound_rises_and_terms_match_sparks_model(spark, corpus):
    model = lda.fit_lda_table(corpus, k=3, rounds=10)
    assert len(model.bounds) == 10
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    rows = lda.lda_terms(model, 5).collect()
    want = sorted(map(sorted, THEMES))
    assert themes(rows) == want
    other, _ = tp.fit_lda(corpus, k=3, max_iter=40)
    assert themes(tp.topic_terms(other, 5).collect()) == want
    for r in rows:
        assert r["label"].startswith(f"Topic {r['topic'] + 1}: ") and len(r["label"].split(", ")) == 5
        assert 0 < r["weight"] < 1
    shares = model.documents.collect()
    assert len(shares) == 90 and all(sum(r["topic_distribution"]) == pytest.approx(1) for r in shares)


def test_topics_stay_in_tables(spark, corpus, monkeypatch):
    """Nothing as long as the vocabulary reaches the driver."""
    from pyspark.sql.classic.dataframe import DataFrame
    sizes, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(got := real(self))) or got)
    lda.fit_lda_table(corpus, k=3, rounds=2)
    assert max(sizes) <= lda.MIN_DOCS
    monkeypatch.undo()


def test_digamma():
    x = np.array([0.05, 0.5, 1.0, 3.7, 6.0, 250.0])
    slope = (np.vectorize(math.lgamma)(x + 1e-5) - np.vectorize(math.lgamma)(x - 1e-5)) / 2e-5
    assert lda.digamma(x) == pytest.approx(slope, rel=1e-5, abs=1e-6)
    assert lda.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)


def test_odd_rows(spark, corpus):
    assert lda.fit_lda_table(corpus.limit(5), k=2, rounds=1) is None
    alone = spark.createDataFrame([(str(d), f"{chr(97 + d) * 30} only here", 1) for d in range(12)],
                                  "recommendation_id string, review string, voted_up int")
    model = lda.fit_lda_table(alone, k=2, rounds=1, min_df=50)
    assert model.bounds == [] and model.documents.count() == 0 and lda.lda_terms(model).count() == 0
    odd = corpus.unionByName(spark.createDataFrame([(None, None, None), ("x", "", 1), ("y", "!" * 99, 0)], corpus.schema))
    assert lda.fit_lda_table(odd, k=2, rounds=1).documents.count() == 90
    assert lda.lda_terms(lda.fit_lda_table(odd.select("*", F.lit(1).alias("term")), k=2, rounds=1)).count() == 20


def test_documents_settle_together_as_alone():
    """The E step of a run of documents is that of each document by itself."""
    rng = np.random.default_rng(3)
    beta = rng.random((12, 3))
    d = np.repeat([0, 1, 2, 3], [5, 1, 8, 3])
    t, n = rng.integers(0, 12, len(d)), rng.integers(1, 4, len(d)).astype(float)
    gamma, stats, bound = lda._e_step(beta, d, t, n, 4, 0.1)
    alone = [lda._e_step(beta, np.zeros((d == k).sum(), int), t[d == k], n[d == k], 1, 0.1) for k in range(4)]
    assert np.allclose(gamma, np.concatenate([a[0] for a in alone]), rtol=1e-12)
    assert np.allclose(stats, np.concatenate([a[1] for a in alone]), rtol=1e-12)
    assert bound == pytest.approx(sum(a[2] for a in alone))
    assert list(lda._runs(d, 4)) == [(0, 5), (5, 14), (14, 17)]


def test_topics_do_not_depend_on_the_blocks(spark, corpus, monkeypatch):
    from plaudit.operators import blocks
    one = lda.fit_lda_table(corpus, k=3, rounds=3)
    monkeypatch.setattr(blocks.pack, "__defaults__", (100,))
    many = lda.fit_lda_table(corpus, k=3, rounds=3)
    assert one.bounds == pytest.approx(many.bounds)
    a, b = ({r["term"]: r["weights"] for r in m.topics.collect()} for m in (one, many))
    assert a.keys() == b.keys() and all(np.allclose(a[t], b[t]) for t in a)


def test_online_topics_stay_in_tables(spark, corpus, monkeypatch):
    """Neither vocabulary nor topic matrix reaches the driver, when fitting or asking."""
    from pyspark.sql.classic.dataframe import DataFrame
    sizes, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(got := real(self))) or got)
    model, docs = tp.fit_lda(corpus, k=3, max_iter=3)
    terms, shares = tp.topic_terms(model, 5), tp.document_topics(model, docs)
    assert max(sizes) <= tp.MIN_DOCS
    monkeypatch.undo()
    assert terms.count() == 15 and model.topics.count() == 15
    got = shares.collect()
    assert len(got) == 90 and all(sum(r["mixture"]) == pytest.approx(1) for r in got)
    assert all(r["dominant_topic"] == int(np.argmax(r["mixture"])) for r in got)


def test_online_round_by_hand(spark, corpus, monkeypatch):
    """One round over all documents against a plain loop over them."""
    monkeypatch.setattr(tp, "BATCH", 2.0)
    first, docs = tp.fit_lda(corpus, k=3, max_iter=0)
    lam = {r["term"]: np.array(r["weights"]) for r in first.topics.collect()}
    after, _ = tp.fit_lda(corpus, k=3, max_iter=1)
    total, stats, shares = sum(lam.values()), {t: np.zeros(3) for t in lam}, []
    for r in docs.collect():
        terms, n = np.unique([t for t in r["tokens"] if t in lam], return_counts=True)
        beta = np.exp(lda.digamma(np.array([lam[t] for t in terms])) - lda.digamma(total))
        gamma = np.full(3, 1 / 3) + n.sum() / 3
        for _ in range(INNER):
            last, theta = gamma, np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
            gamma = 1 / 3 + (beta * theta / (beta @ theta)[:, None] * n[:, None]).sum(axis=0)
            if np.abs(gamma - last).mean() < SETTLED:
                break
        theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
        each = beta * theta / (beta @ theta)[:, None] * n[:, None]
        shares.append(lda.digamma(gamma) - lda.digamma(gamma.sum()))
        for t, x in zip(terms, each):
            stats[t] += x
    rate = 1025.0 ** -0.51
    for r in after.topics.collect():
        assert r["weights"] == pytest.approx((1 - rate) * lam[r["term"]] + rate * (1 / 3 + stats[r["term"]]), rel=1e-8)
    shares, a = np.mean(shares, axis=0), np.full(3, 1 / 3)
    slope = lda.digamma(a.sum()) - lda.digamma(a) + shares   # of the mean bound, whose step is Newton's
    curve = np.diag(-trigamma(a)) + trigamma(a.sum())
    assert after.alpha == pytest.approx(a - rate * np.linalg.solve(curve, slope), rel=1e-8)


def test_documents_without_a_term_have_no_mixture(spark, corpus):
    model, _ = tp.fit_lda(corpus, k=3, max_iter=1)
    odd = spark.createDataFrame([("a", 1, ["unknown"]), ("a", 0, []), (None, None, ["sword", "sword"])],
                                "recommendation_id string, voted_up int, tokens array<string>")
    got = sorted((r["recommendation_id"] or "", sum(r["mixture"]), r["dominant_topic"])
                 for r in tp.document_topics(model, odd).collect())
    assert got[0][1] == pytest.approx(1) and got[1:] == [("a", 0.0, 0), ("a", 0.0, 0)]


def test_trigamma():
    x = np.array([0.05, 0.5, 1.0, 3.7, 6.0, 250.0])
    assert trigamma(x) == pytest.approx((lda.digamma(x + 1e-5) - lda.digamma(x - 1e-5)) / 2e-5, rel=1e-4)
    assert trigamma(np.array([1.0]))[0] == pytest.approx(np.pi ** 2 / 6, abs=1e-12)
