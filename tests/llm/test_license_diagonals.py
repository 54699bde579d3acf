"""License scan against word-by-word search, SQL and noised notices."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from plaudit.llm import license_diagonals as ld
from plaudit.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())]


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in ld.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


ODD = ["", " .,;\n", "cc by", "CC BY", "cc-by", "cc by cc by cc", "General Public License", "general public. License!",
       "All rights reserved. all RIGHTS reserved; All rights", "cc by all rights reserved general public license",
       "Kelvin K: cc İ by", "licensЕ été cc by é", "by cc", "x" * 5000 + " cc by",
       "all rights reserved " * 3000, "0 cc by 9", "cc\x00by", "mit license", "MIT  License, apache license 2.0"]


def test_base_places(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(None if k % 4 == 0 else 900 + k // 2, t) for k, t in enumerate(ODD * 2)]
    rows += [(7, None), (None, None), (5, "twice cc by"), (5, "twice cc by"), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select(
        "*", F.lit(1).alias("label"), F.lit("a").alias("tid"), F.lit("b").alias("n_words"))
    got = [tuple(r) for r in ld.license_report(df).select(*COLUMNS).collect()]
    assert sorted([r[:6] for r in got], key=str) == sorted([(d, *base(t)) for d, t in rows], key=str)
    for r in got:
        assert 0 <= r[7] <= 1 and set(filter(None, r[5].split(","))) <= set(filter(None, r[6].split(",")))
        assert list(filter(None, r[6].split(","))) == sorted(set(filter(None, r[6].split(","))))


def test_many_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ld, "DEALT", 7)
    df = spark.createDataFrame([(None, "cc by")] * 50 + [(1, "cc by")] * 3 + [(1, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_base"]) for r in ld.license_report(df).collect()), key=str)
    assert got == sorted([(None, 1)] * 50 + [(1, 1)] * 3 + [(1, 0)], key=str)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op12_license_diagonals']})").fetchall()
    got = [tuple(r) for r in QUERIES["op12_license_diagonals"](spark, SF).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0])


NOTICE = next(t for t, label in ld.TEMPLATES.items() if label == "bsd" and len(t) > 50)


def test_noised_notices(spark):
    """Words put in, left out and changed shift the diagonal; far parts don't add up."""
    w = NOTICE.split()
    rows = {
        1: "x y " + NOTICE + " z", 2: " ".join(w[:6] + ["added"] + w[6:]), 3: " ".join(w[:9] + w[10:]),
        4: " ".join(w[:12] + ["other"] + w[13:]), 5: " ".join(w[:5]),
        6: " ".join(w[:6]) + " far" * 200 + " " + " ".join(w[6:]), 7: " ".join(reversed(w)),
        8: " | ".join([NOTICE] * 3).upper()}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {}
    for r in ld.license_spans(df).collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["first_word"], r["end_word"]))
    assert got[1] == [("bsd", 2, 2 + len(w))]
    assert set(got) == {1, 2, 3, 4, 6, 8} and len(got[8]) == 3
    assert all({x[0] for x in v} == {"bsd"} for v in got.values())
    assert got[6][0][1] > 150  # the second part alone


def test_own_templates_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(1, "Donné sous Licence Ouverte 2.0 — étalab")], "doc_id long, text string")
    own = {"licence ouverte 2 0": "etalab", "donné sous": "given"}
    assert ld.license_report(df, {}, own).first()["labels"] == "etalab,given"
    assert ld.license_report(df, {}, {}).first()["labels"] == ""
    with pytest.raises(ValueError):
        ld.license_report(df, {}, {"alone": "x"})
    out = ld.license_report(no_docs)
    assert out.columns == COLUMNS and out.count() == 0


def test_native_plan(spark, docs):
    plan = ld.license_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
