"""Embedding near-dedup by a pivot-permutation index.

Every vector is described by the ordered list of its ``prefix`` nearest reference
points (pivots). Inverted lists (label, pivot) bring together the vectors that have
a pivot in common; two vectors that share at least ``min_shared`` pivots of their
prefixes are candidates and are verified by cosine in double precision. A pair that
meets in several lists is decided in the list of the first pivot both have, so every
link is counted once and no pairs are shuffled: a list emits, per vector, its number
of links and the smallest vector of its part of the graph.

Vectors equal in label and components collapse to their smallest id with a
multiplicity first. Lists longer than ``block_rows`` are dealt out as pairs of
blocks, so a hot list is split over many tasks and still compared whole.

Pivots come from a bounded sample: of at most ``4 * pivots`` vectors chosen by hash,
those not close to one taken before; seeded random directions fill up. Every
vector is indexed. Vectors that are null, zero, or hold null or non-finite
components, and vectors with a null label, link with nothing (0 links, own
component). Vectors of different lengths never link. A null id gets a null component
and links with nothing. Repeated rows with one id are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import components, hashed_sample, written
from plaudit.llm.lsh_forest import runs


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision (scaled first, so that nothing overflows)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: list, dim: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(dim)
    own = [np.asarray(v) for v in sample if len(v) == dim]
    pool = unit(np.concatenate([np.stack(own), rng.normal(size=(2 * n, dim))]) if own
                else rng.normal(size=(2 * n, dim)))
    taken = pool[:1]
    for row in pool[1:]:
        if len(taken) == n:
            break
        if dim < 8 or (taken @ row).max() < 0.8:
            taken = np.concatenate([taken, row[None]])
    return taken


def _describe(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches):
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            near: list = [None] * len(vecs)
            by: dict[int, list[int]] = {}
            for k, v in enumerate(vecs):
                by.setdefault(len(v), []).append(k)
            for dim, ks in by.items():
                close = unit(np.array([vecs[k] for k in ks])) @ pivots[dim].T
                top = np.argsort(-close, axis=1, kind="stable")[:, :prefix]
                for k, row in zip(ks, top):
                    near[k] = row.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns)), pa.array(near, pa.list_(pa.int32()))],
                [*batch.schema.names, "near"])
    return run


def part_labels(adj: np.ndarray) -> np.ndarray:
    """Smallest row index of each row's connected part of a symmetric 0/1 matrix."""
    n = len(adj)
    lab = np.arange(n)
    while True:
        low = np.where(adj, lab[None, :], n).min(1)
        new = np.minimum(lab, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _verify(threshold: float, min_shared: int):
    def run(batches):
        for (_, pivot, lo, hi), t in runs(batches, ["grp", "pivot", "lo", "hi"]):
            ids = t.column("vec_id").to_numpy()
            if len(ids) < 2:
                continue
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            mult = t.column("mult").to_numpy()[order]
            block = t.column("block").to_numpy()[order]
            flat = t.column("embedding").combine_chunks()
            x = unit(flat.values.to_numpy(zero_copy_only=False)[
                flat.offsets[0].as_py():].reshape(len(ids), -1)[order])
            near = np.array(t.column("near").to_pylist())[order]
            has = np.zeros((len(ids), int(near.max()) + 1), np.float32)
            has[np.arange(len(ids))[:, None], near] = 1
            link = (x @ x.T) >= threshold
            link &= (has @ has.T) >= min_shared
            first = has[:, :pivot]
            link &= (first @ first.T) == 0
            link &= ((block[:, None] == lo) & (block[None, :] == hi)) | ((block[:, None] == hi) & (block[None, :] == lo))
            np.fill_diagonal(link, False)
            some = np.flatnonzero(link.any(1))
            if not len(some):
                continue
            n = link[some] @ mult
            root = ids[part_labels(link)[some]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some], pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())],
                ["vec_id", "n", "root"])
    return run


def near_vectors(table: DataFrame, threshold: float = 0.93, pivots: int = 256, prefix: int = 10,
                 min_shared: int = 2, block_rows: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of
    ``table(vec_id, embedding, label)``."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
                        & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                        F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"),
                        usable.alias("usable"))
    key = F.xxhash64("label", "embedding")
    good = rows.where("usable")
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult"))
                      .select("vec_id", "embedding", "mult", "label",
                              F.xxhash64("label", F.size("embedding")).alias("grp")), "vectors")
    sizes = [r[0] for r in classes.select(F.size("embedding").alias("n")).distinct().collect()]  # lengths met
    refs = {}
    for dim in sizes:
        own = classes.where(F.size("embedding") == dim)
        sample = hashed_sample(own.select("vec_id", "embedding"), F.xxhash64("vec_id"), 4 * pivots,
                               own.count()).orderBy(F.xxhash64("vec_id"), "vec_id").collect()
        refs[dim] = choose_pivots([r["embedding"] for r in sample], dim, pivots)
    described = classes.select("vec_id", "embedding", "mult", "grp").mapInArrow(
        _describe(refs, prefix), "vec_id long, embedding array<double>, mult long, grp long, near array<int>")
    posts = written(described, "permutations").withColumn("pivot", F.explode("near"))
    n = posts.groupBy("grp", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    cells = (posts.join(n, ["grp", "pivot"]).withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("lo", F.least("block", "o")).withColumn("hi", F.greatest("block", "o"))
             .drop("blocks", "n", "o"))
    found = written(cells.repartition("grp", "pivot", "lo", "hi").sortWithinPartitions("grp", "pivot", "lo", "hi")
                    .mapInArrow(_verify(threshold, min_shared), "vec_id long, n long, root long"), "links")
    comps = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    per = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    by_class = (classes.join(per, "vec_id", "left").join(comps, F.col("vec_id") == F.col("node"), "left")
                .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                        F.coalesce("component_id", "vec_id").alias("c")))
    linked = good.join(by_class, ["label", "embedding"]).select("vec_id", "n_links", F.col("c").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
