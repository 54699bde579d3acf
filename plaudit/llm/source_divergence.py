"""Source divergence audit: all pairs of a language's sources over its terms, by
K-squared quadtrees.

Counts of (language, source, term) form a matrix for each language: a row per source,
a column per kept term. The columns are cut by hash into strips of about STRIP terms,
the rows into tiles of SIDE sources. A tile of a strip is a quadtree of SIDE x SIDE
leaves (a leaf: one source, a few neighbouring terms) that is divided by 4 both ways
(K = 4, 16 children) and keeps only its nonzero leaves. Two tiles are traversed jointly:
where the quadrants of both are all zero, each pair of their sources differs by the
same amount in every term, so the quadrant costs its number of terms times the
difference of the two sources' zero probabilities; only leaves that hold a count in
one of the two are compared term by term.

Probabilities are whole billionths (see ``billionths``), so all arithmetic is exact.

A text's terms are split as bytes and counted in the tasks, over many texts at a time,
and summed by Spark. A strip of two tiles is a group of the shuffle with at
most 2 * SIDE sources of its terms, whatever the corpus holds; strips grow in number
with the terms, and each source's column entries are sent once per tile of its language.
The sums of pairs add up over strips with a map-side combine. The result has a row for
each ordered pair of a language's sources, as asked.

Null text, language or source count as ''. Every (language, source) that occurs is a
group, also without terms; a language without kept terms has pairs with value 0. Rows
count one by one, ids are not read; other columns are ignored, whatever their names.
Ties are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.common import written

BILLION = 1_000_000_000
SIDE = 256         # leaves of a tile's side: 4 ** 4
STRIP = 2048       # terms of a strip, about
FLUSH_TERMS = 400_000
LEAVES = 1 << 16   # pairs of leaves compared at once
#: bytes of terms: letters (A-Z lower-cased) and everything beyond ASCII; others part them
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, d)``: occurrences and documents; a null term for each
    group, so that groups without terms stay."""
    names = ["lang", "source", "term", "n", "d"]

    def run(batches):
        found: dict[tuple, tuple[Counter, Counter]] = {}
        groups = set()

        def flush():
            for (lang, source), (n, d) in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source), len(n)),
                     pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array(map(d.__getitem__, n), pa.int64())], names)
            found.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                groups.add((lang, source))
                terms = text.encode().translate(_TERM).split()
                if terms:
                    n, d = found.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(n)
                    n.update(terms)
                    d.update(set(terms))
                    size += len(n)
                if size > FLUSH_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in groups], pa.string()), pa.array([k[1] for k in groups], pa.string()),
             pa.nulls(len(groups), pa.string()), *[pa.array([0] * len(groups), pa.int64())] * 2], names)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def billionths(count: str, total: str, terms: str):
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact; null without terms."""
    return F.expr(f"case when {terms} > 0 then 1 + (cast({BILLION} as decimal(10,0)) * cast({count} + 5 as "
                  f"decimal(19,0))) div cast({total} + 5 * {terms} as decimal(19,0)) end")


class Quadtree:
    """Nonzero leaves of a tile. ``levels``: occupancy of the 4^k x 4^k quadrants, from
    the root down; ``leaf``: number of a nonzero leaf, -1 where it is zero; ``values``: the
    leaves' shares, zeros filled with the source's zero share."""

    def __init__(self, row: np.ndarray, column: np.ndarray, share: np.ndarray, zero: np.ndarray, width: int):
        occupied = np.zeros((SIDE, SIDE), bool)
        occupied[row, column // width] = True
        self.leaf = np.full((SIDE, SIDE), -1, np.int64)
        r, c = np.nonzero(occupied)
        self.leaf[r, c] = np.arange(len(r))
        self.values = np.repeat(zero[r], width).reshape(len(r), width)
        self.values[self.leaf[row, column // width], column % width] = share
        self.levels = [occupied]
        while len(self.levels[0]) > 1:
            side = len(self.levels[0]) // 4
            self.levels.insert(0, self.levels[0].reshape(side, 4, side, 4).any(axis=(1, 3)))
        self.zero, self.width = zero, width


def joint_sums(a: Quadtree, b: Quadtree) -> np.ndarray:
    """Sum of |share - share| over all columns, for each row of ``a`` with each of ``b``."""
    sums = np.zeros((SIDE, SIDE), np.int64)
    apart = np.abs(a.zero[:, None] - b.zero[None, :])
    last = len(a.levels) - 1

    def descend(level: int, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
        """Quadrants (x, c) of a with (y, c) of b at a level."""
        some = a.levels[level][x, c] | b.levels[level][y, c]
        if not some.all():
            side, zero = SIDE >> (2 * level), np.zeros((4 ** level, 4 ** level), np.int64)
            np.add.at(zero, (x[~some], y[~some]), side * b.width)
            px, py = np.nonzero(zero)
            for i, j in zip(px.tolist(), py.tolist()):
                rows, cols = slice(i * side, (i + 1) * side), slice(j * side, (j + 1) * side)
                sums[rows, cols] += zero[i, j] * apart[rows, cols]
            x, y, c = x[some], y[some], c[some]
        if level == last:
            for k in range(0, len(x), LEAVES):
                i, j, m = x[k:k + LEAVES], y[k:k + LEAVES], c[k:k + LEAVES]
                p, q = a.leaf[i, m], b.leaf[j, m]
                left = np.where((p >= 0)[:, None], a.values[p] if len(a.values) else 0, a.zero[i][:, None])
                right = np.where((q >= 0)[:, None], b.values[q] if len(b.values) else 0, b.zero[j][:, None])
                np.add.at(sums, (i, j), np.abs(left - right).sum(axis=1))
            return
        kids = np.arange(4)
        for k in range(0, len(x), max(1, LEAVES // 64)):  # 64 children each
            one = slice(k, k + max(1, LEAVES // 64))
            u, v, w = (np.broadcast_to(z[one, None, None, None] * 4 + kids.reshape(shape), (len(z[one]), 4, 4, 4))
                       .ravel() for z, shape in ((x, (4, 1, 1)), (y, (1, 4, 1)), (c, (1, 1, 4))))
            descend(level + 1, u, v, w)

    root = np.zeros(1, np.int64)
    descend(0, root, root, root)
    return sums


def _strip(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of all pairs of sources of two tiles over a strip's terms. ``rows`` holds a
    null term with the zero share of each source of both tiles."""
    _, _, low, high = key
    marks = rows["term"].isna()
    zeros, cells = rows[marks], rows[~marks]
    column, names = pd.factorize(cells["term"])
    width = max(1, -(-len(names) // SIDE))
    trees = []
    for tile in (low, high):
        zero = np.zeros(SIDE, np.int64)
        own = zeros[zeros["tile"] == tile]
        zero[own["row"] % SIDE] = own["share"]
        at = (cells["tile"] == tile).to_numpy()
        trees.append(Quadtree((cells["row"].to_numpy() % SIDE)[at], column[at], cells["share"].to_numpy()[at], zero,
                              width))
    sums = joint_sums(*trees)
    sums -= (SIDE * width - len(names)) * np.abs(trees[0].zero[:, None] - trees[1].zero[None, :])  # columns of no term
    x, y = (np.sort(zeros.loc[zeros["tile"] == t, "row"].unique()) for t in (low, high))
    i, j = np.repeat(x, len(y)), np.tile(y, len(x))
    value = sums[i % SIDE, j % SIDE]
    keep = i < j if low == high else np.ones(len(i), bool)
    return pd.DataFrame({"lang": key[0], "i": i[keep], "j": j[keep], "value": value[keep]})


def divergence(docs: DataFrame, least: int = 30, top: int = 50, strip: int = STRIP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` holds every other source
    of the language, part ``term`` the ``top`` terms that a source has more often than its
    language. Terms are kept in at least ``least`` documents of a language."""
    counts = written(term_counts(docs), "terms")
    kept = written(counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least).drop("d"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    cells = written(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]),
                    "cells")
    groups = counts.where("term is null").select("lang", "source").join(
        cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left") \
        .join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]) \
        .withColumn("row", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = written(groups.withColumn("zero", F.coalesce(billionths("0L", "total", "terms"), F.lit(0)))
                     .withColumn("tiles", F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / SIDE) + 1)
                     .withColumn("tile", F.floor(F.col("row") / SIDE))
                     .withColumn("strips", F.greatest(F.lit(1), F.ceil(F.col("terms") / strip))), "groups")
    cells = cells.join(groups, ["lang", "source"]).withColumn("share", billionths("n", "total", "terms"))

    # part term
    own = cells.withColumn("lang_share", billionths("lang_n", "lang_total", "terms")).where("share > lang_share")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                       (F.col("share") - F.col("lang_share")).alias("value")) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # part pair: cells and a mark per source go to every pair of tiles that theirs is in
    marked = cells.select("lang", "row", "tile", "tiles", "term", "share", F.pmod(
        F.xxhash64("term"), F.col("strips")).alias("strip")).unionByName(
        groups.select("lang", "row", "tile", "tiles", F.lit(None).cast("string").alias("term"),
                      F.col("zero").alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))
                      .alias("strip")))
    dealt = marked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))) \
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    sums = dealt.groupBy("lang", "strip", "low", "high").applyInPandas(
        _strip, "lang string, i long, j long, value long") \
        .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(
        F.struct(F.col("i").alias("row"), F.col("j").alias("other")),
        F.struct(F.col("j").alias("row"), F.col("i").alias("other")))).alias("p")).select("lang", "value", "p.*")
    name = groups.select("lang", F.col("row").cast("long").alias("row"), "source")
    pairs = both.join(name, ["lang", "row"]).join(
        name.select("lang", F.col("row").alias("other"), F.col("source").alias("item")), ["lang", "other"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


def divergence_sql(least: int = 30, top: int = 50) -> str:
    """DuckDB SQL of ``divergence`` over ``documents``, term by term."""
    share = "1 + ({b}::HUGEINT * ({n} + 5)) // ({total} + 5 * terms)"
    p, q = (share.format(b=BILLION, n=n, total=t) for n, t in (
        ("coalesce(n, 0)", "total"), ("lang_n", "lang_total")))
    return rf"""WITH doc AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\x{{80}}-\x{{10ffff}}]+') AS w FROM documents),
tok AS (SELECT k, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tok GROUP BY ALL HAVING count(DISTINCT k) >= {least}),
langs AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM doc)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, n, {p} AS p, {q} AS q
      FROM grp JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
al AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
       FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
       UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM al)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM rk WHERE part = 'pair' OR rank <= {top}"""
