"""Source divergence against plain counting, joint traversal against dense sums."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.llm import source_divergence as sd
from plaudit.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=30, top=50):
    counts, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.decode() for t in re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode().lower())]
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    kept = {lang: sorted(t for t, d in docs[lang].items() if d >= least) for lang in langs}

    def shares(count, terms):
        n = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(terms)) for t in terms}
    p = {g: shares(c, kept[g[0]]) for g, c in counts.items()}
    q = {lang: shares(c, kept[lang]) for lang, c in langs.items()}
    for lang, source in counts:
        mine = p[lang, source]
        pairs = [(-sum(abs(mine[t] - p[lang, s][t]) for t in mine), s.encode()) for x, s in counts
                 if x == lang and s != source]
        terms = [(q[lang][t] - mine[t], t.encode()) for t in mine
                 if counts[lang, source][t] and mine[t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, s.decode(), -v, k) for k, (v, s) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_matches_sql_and_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_source_divergence']})").fetchall())
    out = got(QUERIES["op11_source_divergence"](spark, SF))
    assert out == want
    assert out == brute([tuple(r) for r in docs.select("lang", "source", "text").collect()])


@pytest.mark.parametrize("strip,flush", [(3, 1 << 20), (1 << 20, 5)])
def test_odd_rows(spark, strip, flush, monkeypatch):
    """Nulls, empty groups, ties, letters of all scripts, many strips, many flushes."""
    monkeypatch.setattr(sd, "FLUSH_TERMS", flush)
    rng = np.random.default_rng(3)
    words = ["the", "Über", "über", "É", "é", "日本", "a1b", "x-y", "İ", "K", "zoo", "\U0001f642"]
    rows = [(["en", "de", None, "xx"][rng.integers(0, 3)], ["s1", "s2", "s10", "é", None, "", "S"][rng.integers(0, 7)],
             " ".join(rng.choice(words, rng.integers(0, 30)))) for _ in range(150)]
    rows += [("en", "none", None), ("en", "void", "123 !!"), ("lone", "one", "a b"), ("bare", "a", None),
             ("bare", "b", ""), ("en", "s1", "rare word"), ("en", "long", "the zoo " * 50_000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4) \
        .select("*", F.lit(1).alias("term"), F.lit("q").alias("row"), F.lit(2).alias("n"))
    assert got(sd.divergence(df, 5, 4, strip)) == brute(rows, 5, 4)


def test_many_sources_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(sd, "SIDE", 4)
    rng = np.random.default_rng(5)
    rows = [("en", f"s{k % 11}", " ".join(f"{'abcdefghij'[i]}x" for i in rng.zipf(1.6, 12) % 10)) for k in range(120)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    out = sd.divergence(df, 2, 50, 4)
    assert got(out) == brute(rows, 2)


def test_joint_sums_match_dense():
    rng = np.random.default_rng(7)
    for fill in (0.0, 0.001, 0.05):
        trees, dense = [], []
        for _ in range(2):
            zero = rng.integers(1, 50, sd.SIDE)
            full = np.repeat(zero, sd.SIDE * 2).reshape(sd.SIDE, sd.SIDE * 2)
            at = np.flatnonzero(rng.random(full.size) < fill)
            full.ravel()[at] = rng.integers(50, 90, len(at))
            trees.append(sd.Quadtree(at // (sd.SIDE * 2), at % (sd.SIDE * 2), full.ravel()[at], zero, 2))
            dense.append(full)
        want = np.stack([np.abs(row - dense[1]).sum(axis=1) for row in dense[0]])
        assert (sd.joint_sums(*trees) == want).all()


def test_empty_table(spark):
    out = sd.divergence(spark.createDataFrame([], "lang string, source string, text string"))
    assert out.columns == COLUMNS and out.count() == 0
