"""Near duplicates by an LSH forest over MinHash signatures, links confirmed on sets.

A text's set holds its distinct ``width``-word shingles (64-bit hashes; words are
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shorter text is one shingle).
Texts with the same set collapse to their smallest id first, so copies cost one row.

``TREES`` trees order the representatives by a signature of ``DEPTHS[-1]`` MinHash
values each; a lower threshold takes more trees (``trees_for``), which start further
on in the same signatures. Rows that share a prefix of ``DEPTHS[0]`` values form a
region of a tree; a region of more than ``region_rows`` rows is taken at the next
depth, where fewer rows share the (longer) common prefix, until it fits or the
signature ends. That only finds most links sooner: rows of the region at ``DEPTHS[0]``
that are still in different components afterwards are compared as well, all of them.
Regions above ``block_rows`` rows are dealt out as pairs of blocks, so a region of
any size is compared whole, by many tasks; pairs of blocks of one component are left
out. The candidates of a row in a block pair
are its ``pool`` partners of highest estimated similarity over all trees' values, and
pairs that connect whatever further candidates connect.

Each row's best candidates are confirmed on the full sets first. What they leave
apart is decided in groups of rows that candidates connect: rows of different
components in one group are compared exactly, block pair by block pair, until they are
joined or no candidate is left. A pair inside one component needs no test and no pair
is emitted but links, so a large group of copies costs about two tests a row and no
link between components is lost. Candidates need an estimate of at least ``floor``, 4
standard errors below the threshold.

Null or empty texts have no shingles and link with nothing. A null id is kept, gets
a null component and links with nothing. Repeated rows with one id get one row each.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.common import components, written

TREES = 10
DEPTHS = (4, 8, 12, 16)
N_HASH = TREES * DEPTHS[-1]
CACHE_WORDS = 1_000_000
_RNG = np.random.default_rng(20240229)
MULT = _RNG.integers(1, 2**63, N_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 2**63, N_HASH, dtype=np.uint64)
STEP = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (multiply and shift twice)."""
    x = (x ^ (x >> np.uint64(32))) * STEP[6]
    x = (x ^ (x >> np.uint64(29))) * STEP[7]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, cache: dict, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    toks = text.lower().split() if text else []
    if not toks:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, toks), np.uint64, len(toks))
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = mix((acc + h[k:len(h) - n + 1 + k]) * STEP[k])
    return np.unique(acc)


def signature(sh: np.ndarray) -> np.ndarray:
    low = np.full(N_HASH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sh), 1024):
        np.minimum(low, (sh[at:at + 1024, None] * MULT + PLUS).min(0), out=low)
    return low


def set_key(sh: np.ndarray) -> bytes:
    return blake2b(sh.tobytes(), digest_size=16).digest()


def trees_for(percent: int, miss: float = 0.001) -> int:
    """Trees that leave a pair at the threshold without a common prefix of
    ``DEPTHS[0]`` values with a chance of at most ``miss`` (at least TREES, at most as
    many as the signature has such prefixes)."""
    link = (percent / 100) ** DEPTHS[0]
    need = math.ceil(math.log(miss) / math.log(1 - link)) if 0 < link < 1 else TREES
    return min(max(TREES, need), N_HASH // DEPTHS[0])


def tree_keys(sig: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """(row, tree) -> 64-bit key of the tree's signature prefix of that depth. Trees
    behind the first TREES begin DEPTHS[0] values further on in the same signatures."""
    per = sig.reshape(-1, TREES, DEPTHS[-1]).astype(np.uint64)
    tree = np.arange(trees)
    acc = np.tile((tree + 1).astype(np.uint64) * np.uint64(64) + np.uint64(depth), (len(per), 1))
    for d in range(depth):
        acc = mix((acc + per[:, tree % TREES, (tree // TREES * DEPTHS[0] + d) % DEPTHS[-1]]) * STEP[d % 5])
    return acc


def _tree_rows(depth: int, trees: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2")
                keys = tree_keys(sig, depth, trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), trees)),
                     pa.array(np.tile(np.arange(trees, dtype=np.int32), len(keys))),
                     pa.array(keys.view(np.int64).ravel())], ["rep", "tree", "region"])
    return run


def _signer(width: int):
    def run(batches):
        return _sign(batches, width)
    return run


def _sign(batches, width: int):
    cache = _Hashes()
    for batch in batches:
        n, key, sig = [], [], []
        for text in batch.column(1).to_pylist():
            sh = shingles(text, cache, width)
            n.append(len(sh))
            if not len(sh):
                key.append(None), sig.append(None)
                continue
            key.append(set_key(sh))
            sig.append((signature(sh) >> np.uint64(40)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "sig"])


def _setter(width: int):
    def run(batches):
        return _sets(batches, width)
    return run


def _sets(batches, width: int):
    cache = _Hashes()
    for batch in batches:
        sh = [shingles(t, cache, width) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([set_key(s) for s in sh], pa.binary()),
             pa.array([s.view(np.int64) for s in sh], pa.list_(pa.int64()))], ["doc_id", "set_key", "set"])


def runs(batches, key_cols: list[str]):
    """Groups of consecutive rows with equal keys as tables; a group may span batches."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                         for k in key_cols], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(bounds, bounds[1:]):
            k = tuple(keys[a])
            if held and k != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k
    if held:
        yield last, pa.Table.from_batches(held)


def similar(sig: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray, floor: float):
    """Pairs (i, j) of left x right rows in different components whose estimate
    reaches ``floor``, and their equal values."""
    ii, jj, ss = [], [], []
    for at in range(0, len(left), 64):  # bounded memory: 64 x block x N_HASH bytes
        rows = left[at:at + 64]
        hits = (sig[rows][:, None, :] == sig[right][None, :, :]).sum(2, dtype=np.int16)
        hits[comp[rows][:, None] == comp[right][None, :]] = 0
        i, j = np.nonzero(hits >= floor * N_HASH)
        ss.append(hits[i, j])
        ii.append(rows[i])
        jj.append(right[j])
    i, j, s = np.concatenate(ii), np.concatenate(jj), np.concatenate(ss)
    if left is right:
        up = i < j
        i, j, s = i[up], j[up], s[up]
    return i, j, s


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's connected part."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def best_pairs(i: np.ndarray, j: np.ndarray, s: np.ndarray, q: int) -> np.ndarray:
    """Which pairs are among the ``q`` best of one of their rows."""
    end, pair, score = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2), np.tile(s, 2)
    order = np.lexsort((pair, -score, end))
    e = end[order]
    rank = np.arange(len(e)) - np.searchsorted(e, e)
    good = np.zeros(len(i), bool)
    good[pair[order][rank < q]] = True
    return good


def _blocks_of(t: pa.Table, lo: int, hi: int):
    """Rows of a cell in a fixed order: ids, components, signatures, the two blocks."""
    rep = t.column("rep").to_numpy()
    order = np.argsort(rep, kind="stable")  # rows arrive in any order
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, N_HASH)[order]
    block = t.column("block").to_numpy()[order]
    left = np.flatnonzero(block == lo)
    return order, rep[order], sig, left, left if lo == hi else np.flatnonzero(block == hi)


def _compare(q: int, floor: float):
    """Candidates of a region's block pair: the ``q`` best of each row with their equal
    values, and with -1 as many pairs as connect what all candidates connect. Rows with
    the same ``comp`` (where there is one) are no candidates."""
    def run(batches):
        for (_, lo, hi), t in runs(batches, ["region", "lo", "hi"]):
            if t.num_rows < 2:
                continue
            order, rep, sig, left, right = _blocks_of(t, lo, hi)
            if not len(left) or not len(right):
                continue
            part = t.column("comp").to_numpy()[order] if "comp" in t.column_names else np.arange(len(rep))
            i, j, s = similar(sig, left, right, part, floor)
            if not len(i):
                continue
            good = best_pairs(i, j, s, q)
            u, v, hits = rep[i[good]], rep[j[good]], s[good].astype(np.int32)
            if not good.all():
                root = connected(len(rep), i, j)
                more = np.flatnonzero(root != np.arange(len(rep)))
                u, v = np.concatenate([u, rep[more]]), np.concatenate([v, rep[root[more]]])
                hits = np.concatenate([hits, np.full(len(more), -1, np.int32)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(hits)], ["u", "v", "hits"])
    return run


def _decide(percent: int, floor: float):
    """Links between the components of a group's block pair: candidates are compared
    exactly, best estimate first, until their components are joined."""
    def run(batches):
        for (_, lo, hi), t in runs(batches, ["region", "lo", "hi"]):
            comp = t.column("comp").to_numpy()
            if (comp == comp[0]).all():
                continue
            order, rep, sig, left, right = _blocks_of(t, lo, hi)
            if not len(left) or not len(right):
                continue
            names, part = np.unique(comp[order], return_inverse=True)
            i, j, s = similar(sig, left, right, part, floor)
            sets = t.column("set").combine_chunks()
            flat, at = sets.values.to_numpy(), sets.offsets.to_numpy()
            up = np.arange(len(names))
            u, v = [], []
            for k in np.argsort(-s, kind="stable"):
                a, b = part[i[k]], part[j[k]]
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                if a == b:
                    continue
                x, y = (flat[at[order[r]]:at[order[r] + 1]] for r in (i[k], j[k]))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * 100 >= (len(x) + len(y) - both) * percent:
                    up[max(a, b)] = min(a, b)
                    u.append(min(rep[i[k]], rep[j[k]]))
                    v.append(max(rep[i[k]], rep[j[k]]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return run


def regions(reps: DataFrame, region_rows: int, trees: int) -> tuple[DataFrame, DataFrame | None]:
    """(region, n, rep): each tree's rows at the shallowest depth whose region holds
    at most ``region_rows`` rows, or at the full signature; single rows are left out.
    And (region, rep) of the regions at DEPTHS[0] that were taken deeper, if any."""
    parts, todo, large = [], None, None
    for depth in DEPTHS:
        rows = reps.select("rep", "sig").mapInArrow(_tree_rows(depth, trees), "rep long, tree int, region long")
        if todo is not None:
            rows = rows.join(todo, ["rep", "tree"], "left_semi")
        n = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
        got = written(rows.join(n, "region"), f"regions{depth}")
        if depth == DEPTHS[-1]:
            parts.append(got.select("region", "n", "rep"))
            break
        parts.append(got.where(F.col("n") <= region_rows).select("region", "n", "rep"))
        over = got.where(F.col("n") > region_rows)
        todo = over.select("rep", "tree")
        if todo.isEmpty():
            break
        if large is None:
            large = over.select("region", "rep")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, large


def best_per_row(pairs: DataFrame, q: int) -> DataFrame:
    """The ``q`` pairs of most hits at each end."""
    ends = pairs.select("u", "v", "hits", F.explode(F.array("u", "v")).alias("end"))
    w = Window.partitionBy("end").orderBy(F.desc("hits"), "u", "v")
    return ends.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= q).select("u", "v").distinct()


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (region, n, rep) once per pair of blocks that their own block is in."""
    return (rows.withColumn("_b", F.ceil(F.col("n") / block_rows).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_b")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
            .withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o"))
            .drop("n", "_b", "_o"))


def between_components(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (region, rep, comp) once per pair of blocks that can hold rows of different
    components: a component of a block or more has blocks of its own, which need not
    meet one another; the others share blocks. Regions of one component are left out."""
    size = rows.groupBy("region", "comp").agg(F.count("*").alias("n"))
    own = F.col("n") >= block_rows
    per = (size.groupBy("region")
           .agg(F.ceil(F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)) / block_rows).cast("int").alias("_m"),
                F.coalesce(F.sum(F.when(own, F.ceil(F.col("n") / block_rows))), F.lit(0)).cast("int").alias("_t"),
                F.count("*").alias("_c")).where("_c > 1").drop("_c"))
    w = Window.partitionBy("region").orderBy("comp").rowsBetween(Window.unboundedPreceding, 0)
    large = (size.where(own).select("region", "comp", F.ceil(F.col("n") / block_rows).cast("int").alias("_b"))
             .withColumn("_end", F.sum("_b").over(w).cast("int")))  # a row per component of a block or more
    return (rows.join(per, "region").join(large, ["region", "comp"], "left")
            .withColumn("_a", F.coalesce(F.col("_m") + F.col("_end") - F.col("_b"), F.lit(0)))
            .withColumn("_w", F.coalesce("_b", "_m"))
            .withColumn("block", (F.col("_a") + F.pmod(F.xxhash64("rep"), F.col("_w"))).cast("int"))
            .withColumn("_o", F.explode(F.expr("sequence(0, _m + _t - 1)")))
            .where("_b is null or _o < _a or _o >= _a + _w")
            .withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o"))
            .drop("_m", "_t", "_b", "_end", "_a", "_w", "_o"))


def dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3, pool: int = 4, first: int = 2,
                    floor: float | None = None, region_rows: int = 32_768, block_rows: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of
    ``docs(doc_id, text)``; texts with ``100 * |A & B| >= percent * |A | B|`` are
    linked."""
    j = percent / 100
    floor = j - 4 * (j * (1 - j) / N_HASH) ** 0.5 if floor is None else floor
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = written(texts.mapInArrow(
        _signer(width), "doc_id long, n_shingles long, set_key binary, sig binary"), "signatures")
    reps = written(signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
                   .agg(F.min(F.struct("doc_id", "sig")).alias("r"))
                   .select("set_key", F.col("r.doc_id").alias("rep"), "r.sig"), "representatives")
    sigs = reps.select("rep", "sig")
    small, large = regions(reps, region_rows, trees_for(percent))
    cells = in_blocks(small, block_rows).join(sigs, "rep")
    found = _candidates(cells, pool, floor, "candidates")
    sets = _sets_of(texts, reps, found, width)
    links = _confirmed(sets, best_per_row(found.where("hits >= 0"), first), percent)
    comps = components(links)
    if large is not None:  # pairs that the longer prefixes have parted
        cells = between_components(_with_components(large, comps), block_rows).join(sigs, "rep")
        parted = _candidates(cells, pool, floor, "parted")
        found = found.unionByName(parted)
        sets = _sets_of(texts, reps, found, width)
        links = links.unionByName(_confirmed(sets, best_per_row(parted.where("hits >= 0"), first), percent))
        comps = components(links)

    # rows that candidates connect and confirmed links do not
    loose = components(found.select("u", "v")).select(F.col("component_id").alias("region"), F.col("node").alias("rep"))
    cells = (between_components(_with_components(loose, comps), block_rows // 4).join(sigs, "rep")
             .join(sets.withColumnRenamed("doc_id", "rep"), "rep"))
    more = written(dealt(cells).mapInArrow(_decide(percent, floor), "u long, v long"), "links")
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    by_set = reps.select("set_key", "rep").join(comps, F.col("rep") == F.col("node"), "left") \
        .select("set_key", F.coalesce("component_id", "rep").alias("c"))
    own = F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    return signed.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left") \
        .select("doc_id", "n_shingles", own.alias("component_id"),
                F.col("doc_id").eqNullSafe(own).alias("kept"))


def _candidates(cells: DataFrame, pool: int, floor: float, name: str) -> DataFrame:
    return written(dealt(cells).mapInArrow(_compare(pool, floor), "u long, v long, hits int")
                   .groupBy("u", "v").agg(F.max("hits").alias("hits")), name)


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (region, rep) with the component of each; a row without links is its own."""
    return (rows.join(comps, F.col("rep") == F.col("node"), "left")
            .select("region", "rep", F.coalesce("component_id", "rep").alias("comp")))


def _sets_of(texts: DataFrame, reps: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(doc_id, set) of the representatives in some pair, made anew from their texts."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = texts.join(ids, "doc_id", "left_semi") \
        .mapInArrow(_setter(width), "doc_id long, set_key binary, set array<long>") \
        .join(reps.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    return written(sets.drop("set_key").dropDuplicates(["doc_id"]), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("set").alias("su"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("set").alias("sv"))
    both, size = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    return written(pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("i"), size.alias("n"))
                   .where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("u", "v"), "confirmed")
