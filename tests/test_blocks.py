"""Blocks of documents: same cells as plain counts, little left on disk, batches in one pass."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import blocks as bl
from plaudit.operators import lda
from plaudit.operators import topics as tp
from plaudit.operators.blocks import stored

WORDS = ["sword", "dragon", "castle", "quest", "knight", "engine", "wheel", "brake", "track", "pedal"]


def corpus(spark, ids, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(WORDS[j] for j in rng.integers(0, 10, rng.integers(4, 30))) + " and the", 1) for i in ids]
    rows += [("blank", "12345 67890 12345 67890 12345", 0), (None, None, 1), ("short", "sword", 1)]
    return spark.createDataFrame(rows, "recommendation_id string, review string, voted_up int")


def folder(spark):
    from plaudit.session import ensure_checkpoint_dir
    path = ensure_checkpoint_dir(spark).removeprefix("file:") + "/topics"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def weights(packed, terms):
    """(doc, term, w) of blocks, by a plain loop."""
    names = {r["g"]: (r["names"], r["idf"]) for r in terms.collect()}
    out = {}
    for b in packed.collect():
        known = [(names[g][0][a], names[g][1][a]) for g, a in zip(
            np.repeat(b["groups"], b["sizes"]), np.frombuffer(b["at"], np.int32))]
        lengths = np.frombuffer(b["lengths"], np.int32)
        d, t, n = np.repeat(np.arange(len(lengths)), lengths), np.frombuffer(b["t"], np.int32), np.frombuffer(b["x"])
        for i, j, w in zip(d, t, tp._weights(d, t, n, np.array([k[1] for k in known]))):
            assert (b["docs"][i], known[j][0]) not in out
            out[b["docs"][i], known[j][0]] = w
    return out


@pytest.mark.parametrize("ids", [[f"r{i}" for i in range(40)], [f"r{i % 13}" if i % 5 else None for i in range(40)],
                                 [f"r{i % 30}" for i in range(40)]])
def test_blocks_hold_the_plain_cells(spark, monkeypatch, ids):
    """Distinct, repeated and null ids, several blocks and groups."""
    monkeypatch.setattr(bl, "CELLS", 40)
    monkeypatch.setattr(bl, "GROUP", 100)
    df = corpus(spark, ids)
    packed, terms = tp.tfidf_blocks(df, 2.0, 0.95, None)
    assert packed.count() > 3 and terms.count() > 2
    want = {(r["doc"], r["term"]): r["w"] for r in tp.tfidf_cells(df).collect()}
    got = weights(packed, terms)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], rel=1e-12) for c in want)


def test_most_frequent_words_alone(spark):
    df = corpus(spark, [f"r{i}" for i in range(40)])
    packed, terms = tp.tfidf_blocks(df, 2.0, 1.0, 4)
    want = {(r["doc"], r["term"]): r["w"] for r in tp.tfidf_cells(df, max_df=1.0, vocab=4).collect()}
    assert sum(len(r["names"]) for r in terms.collect()) == 4 and weights(packed, terms) == pytest.approx(want)


def test_rounds_leave_no_tables(spark):
    """What lies on disk after a fit doesn't grow with its rounds."""
    df = corpus(spark, [f"r{i}" for i in range(40)])

    def left(fit):
        before = folder(spark)
        fit()
        return len(folder(spark) - before)

    for fit in (lambda n: tp.fit_nmf(df, k=2, max_iter=n, tolerance=-1.0), lambda n: lda.fit_lda_table(df, k=2, rounds=n)):
        few, more = left(lambda: fit(1)), left(lambda: fit(3))
        assert few <= 6 and more <= few + 1


def test_shuffle_files_go_with_the_write(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def files():
        found = env.blockManager().diskBlockManager().getAllFiles().iterator()
        n = 0
        while found.hasNext():
            n += found.next().getName().startswith("shuffle_")
        return n

    key = bl.CLEAN
    before, was = files(), spark.conf.get(key, None)
    tables = [stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t") for _ in range(3)]
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key, None) == was
    assert [t.count() for t in tables] == [7, 7, 7]


def test_tokens_are_made_once(spark):
    df = corpus(spark, [f"r{i}" for i in range(12)])
    plan = tp._worded(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert sorted(r["recommendation_id"] for r in tp._worded(df).collect()) == sorted(f"r{i}" for i in range(12))


def test_batches_are_the_documents_of_the_hash(spark, monkeypatch):
    """All rounds' batches from one pass over the blocks, each with its documents' cells."""
    monkeypatch.setattr(bl, "CELLS", 60)
    monkeypatch.setattr(bl, "GROUP", 200)
    df = corpus(spark, [f"r{i}" for i in range(60)])
    docs = stored(tp._worded(df).withColumn("_row", F.monotonically_increasing_id()), "t")
    packed, terms, _ = tp.lda_blocks(docs, 2.0, 0.95)
    takes = [F.pmod(F.xxhash64("_row", F.lit(42), F.lit(r)), F.lit(5)) == 0 for r in (1, 2, 3)]
    cut = bl.batches(packed, F.transform("docs", lambda x: F.filter(F.array(*[F.lit(r) for r in (1, 2, 3)]), lambda r: F.pmod(
        F.xxhash64(x, F.lit(42), r), F.lit(5)) == 0)), "t")
    names = {r["g"]: r["names"] for r in terms.collect()}
    for r, take in enumerate(takes, 1):
        want = sorted(sorted(x["tokens"]) for x in docs.where(take).collect())
        got = []
        for b in cut.where(F.col("round") == r).collect():
            known = [names[g][a] for g, a in zip(np.repeat(b["groups"], b["sizes"]), np.frombuffer(b["at"], np.int32))]
            t, n = np.frombuffer(b["t"], np.int32), np.frombuffer(b["x"]).astype(int)
            assert set(t) == set(range(len(known)))
            ends = np.cumsum(np.frombuffer(b["lengths"], np.int32))
            got += [sorted(w for j in range(e - length, e) for w in [known[t[j]]] * n[j])
                    for e, length in zip(ends, np.frombuffer(b["lengths"], np.int32))]
        assert want and sorted(got) == want


def test_new_documents_are_asked_like_those_of_the_fit(spark):
    df = corpus(spark, [f"r{i}" for i in range(30)])
    model, docs = tp.fit_lda(df, k=2, max_iter=1)
    again = tp.document_topics(model, docs.select("recommendation_id", "voted_up", "tokens"))
    same, other = ({r["recommendation_id"]: r["mixture"] for r in x.collect()} for x in (tp.document_topics(model, docs), again))
    assert len(same) == 30 and all(sum(same[d]) == pytest.approx(1) and same[d] == pytest.approx(other[d]) for d in same)


def test_models_do_not_depend_on_blocks_and_groups(spark, monkeypatch):
    df = corpus(spark, [f"r{i}" for i in range(60)])

    def fits():
        table, (online, docs) = lda.fit_lda_table(df, k=2, rounds=1), tp.fit_lda(df, k=2, max_iter=1)
        h, w, _ = tp.fit_nmf(df, k=2, max_iter=1)
        return [{r[0]: list(r[1]) for r in x.collect()} for x in (table.topics, online.topics, h, w, tp.document_topics(
            online, docs).select("recommendation_id", "mixture"))] + [{"bounds": table.bounds, "alpha": list(online.alpha)}]

    monkeypatch.setattr(tp, "BATCH", 0.5)
    one = fits()
    monkeypatch.setattr(bl, "CELLS", 60)
    monkeypatch.setattr(bl, "GROUP", 200)
    for a, b in zip(one, fits()):
        assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], rel=1e-8) for x in a)
