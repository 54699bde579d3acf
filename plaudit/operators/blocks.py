"""A document-term matrix in blocks of whole documents, for iterative models.

Documents become blocks in the tasks that read them (``gather``), a row each: documents,
terms, and cells as positions in both. Terms lie in groups by a hash; a group's rows of
factors are one row, too. In a round every group sends a block the factors of the block's
terms as one array, the block sends one array back per group, and the group adds them up:
so a round shuffles the blocks and (block, term) pairs as bytes, no row per cell, term or
document, and writes one array per group. No table of terms or documents meets in one task
or on the driver. Shuffle files go when their table is written, tables of past rounds when
the next one is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.session import scratch_path

#: cells of a block at most (one document may have more), tokens for which there is a group
CELLS, GROUP = 2_000_000, 1_000_000
RAW = "names array<string>, groups array<int>, sizes array<int>, lengths binary, t binary, x binary"
PACKED = "groups array<int>, sizes array<int>, at binary, lengths binary, t binary, x binary"
ROUND = "kind int, id long, f array<double>"
TERM, FACTORS, TOTALS = 0, 1, 2   # kinds of a round's rows; ``id`` is a group for TERM, else a block
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write an intermediate table under the shared folder and read it back. The write's
    shuffle files are removed as soon as it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, f"topics/{name}-{uuid.uuid4().hex}")
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Remove tables that ``stored`` wrote and nothing will read again."""
    for df in frames:
        if df is not None and hasattr(df, "stored_at"):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            try:
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            except Py4JError:   # it only takes room
                pass


def _bytes(a: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _row(schema: T.StructType, *values) -> pa.RecordBatch:
    """One row of bytes, numbers, numpy and Arrow arrays."""
    cols = []
    for field, v in zip(schema, values):
        if isinstance(field.dataType, T.ArrayType):
            v = v if isinstance(v, pa.Array) else pa.array(v, pa.int32())
            cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            kind = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}[type(field.dataType)]
            cols.append(pa.array([v], kind))
    return pa.RecordBatch.from_arrays(cols, names=schema.names)


def _schema(ddl: str, *docs: T.StructField) -> T.StructType:
    fields = T.StructType.fromDDL(ddl).fields
    return T.StructType([T.StructField("block", T.LongType()), *docs, *fields]) if docs else T.StructType(fields)


def _values(column, kind) -> np.ndarray:
    return np.frombuffer(column[0].as_py(), kind)


def _list(column) -> np.ndarray:
    return column[0].values.to_numpy(zero_copy_only=False)


def _cells(row: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, t, x) of a block."""
    lengths = _values(row.column("lengths"), np.int32)
    return np.repeat(np.arange(len(lengths)), lengths), _values(row.column("t"), np.int32), _values(row.column("x"), float)


def _joined(parts: list[pa.Array]) -> pa.Array:
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _encoded(values: pa.Array) -> pa.DictionaryArray:
    got = values.dictionary_encode()
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def _raw(schema: T.StructType, block: int, docs: pa.Array, lengths: np.ndarray, names: pa.Array, t: np.ndarray,
         x: np.ndarray, groups: int) -> pa.RecordBatch:
    """A block's row, its terms in order of their groups."""
    group = np.fromiter((crc32(s) % groups for s in names.cast(pa.binary()).to_pylist()), np.int32, len(names))
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    found, sizes = np.unique(group, return_counts=True)
    return _row(schema, block, docs, names.take(pa.array(order)), found, sizes,
                _bytes(lengths, np.int32), _bytes(place[t], np.int32), _bytes(x, float))


def gather(docs: DataFrame, doc: str, name: str, groups: int, size: int) -> DataFrame:
    """Blocks (block, docs, ``RAW``) of documents (``doc``, tokens) that each have a row of
    their own: cells are the counts of a document's terms. Nothing is shuffled."""
    schema = _schema(RAW, T.StructField("docs", T.ArrayType(docs.schema[doc].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, cells = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            words = _encoded(_joined([p[2] for p in parts]))
            index, first, t = words.indices.to_numpy(), 0, []
            for p in parts:
                t.append(index[first:first + len(p[2])][p[3]])
                first += len(p[2])
            return _raw(schema, block, _joined([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                        words.dictionary, np.concatenate(t), np.concatenate([p[4] for p in parts]), groups)

        for batch in batches:
            ends = batch.column(1).offsets.to_numpy().astype(np.int64)
            first = 0
            while first < batch.num_rows:   # as many documents as have ``size`` tokens
                end = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
                words = _encoded(batch.column(1).values.slice(ends[first], ends[end] - ends[first]))
                wide = max(1, len(words.dictionary))
                key = np.repeat(np.arange(end - first), np.diff(ends[first:end + 1])) * wide + words.indices.to_numpy()
                key, count = np.unique(key, return_counts=True)
                lengths = np.bincount(key // wide, minlength=end - first)
                if cells and cells + len(key) > size:
                    yield flush()
                    block, parts, cells = block + 1, [], 0
                parts.append((batch.column(0).slice(first, end - first), lengths, words.dictionary, key % wide,
                              count.astype(float)))
                cells, first = cells + len(key), end
        if cells:
            yield flush()

    return stored(docs.select(doc, "tokens").mapInArrow(run, schema), name)


def pack(cells: DataFrame, doc: str, value: str, name: str, size: int = CELLS, *, groups: int = 1) -> DataFrame:
    """Blocks like those of ``gather`` of stored cells (``doc``, term, ``value``), which are
    shuffled; their numbers are negative."""
    blocks = max(1, -(-cells.count() // size))
    schema = _schema(RAW, T.StructField("docs", T.ArrayType(cells.schema[doc].dataType)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        d, t = (_encoded(_joined(table.column(c).chunks)) for c in (1, 2))
        order = np.argsort(d.indices.to_numpy(), kind="stable")
        return pa.Table.from_batches([_raw(
            schema, table.column(0)[0].as_py(), d.dictionary, np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary)),
            t.dictionary, t.indices.to_numpy()[order], table.column(3).to_numpy()[order], groups)])

    dealt = cells.select((-1 - F.pmod(F.xxhash64(doc), F.lit(blocks))).alias("block"), doc, "term", F.col(value).cast("double"))
    return stored(dealt.groupBy("block").applyInArrow(run, schema), name)


def shape(docs: DataFrame) -> tuple[int, int, int]:
    """Of documents (tokens): their number, and the groups of terms and cells of a block for them."""
    n, tokens = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return n, 1 + tokens // GROUP, min(CELLS, max(100_000, tokens // (4 * cores)))


def term_counts(raw: DataFrame) -> DataFrame:
    """(g, term, df, n): documents that have the term, sum of its cells."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                d, t, x = _cells(row)
                names = row.column("names")[0].values
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(_list(row.column("groups")), _list(row.column("sizes"))), pa.int32()), names,
                    pa.array(np.bincount(t, minlength=len(names)), pa.int64()),
                    pa.array(np.bincount(t, x, len(names)))], names=["g", "term", "df", "n"])

    one = raw.select("names", "groups", "sizes", "lengths", "t", "x").mapInArrow(run, "g int, term string, df long, n double")
    return one.groupBy("g", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def in_groups(terms: DataFrame, name: str, *more: str) -> DataFrame:
    """(g, names and arrays of the columns ``more``) of terms (g, term, ...), stored."""
    rows = F.sort_array(F.collect_list(F.struct("term", *more)))
    return stored(terms.groupBy("g").agg(rows.alias("r")).select("g", F.col("r.term").alias("names"), *[
        F.col("r")[c].alias(c) for c in more]), name)


def trim(raw: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """Blocks (block, docs, ``PACKED``) with the terms (g, names) alone, without documents
    that have none. ``at`` is a term's position in its group."""
    def slices(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, sizes = batch.column(1)[i].values, batch.column(3)[i].values.to_numpy()
                ends = np.cumsum(sizes)
                g = batch.column(2)[i].values
                yield pa.RecordBatch.from_arrays([
                    g.cast(pa.int32()), pa.array(np.full(len(g), batch.column(0)[i].as_py())),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), names)], names=["g", "block", "asked"])

    def find(known: pa.Table, asked: pa.Table) -> pa.Table:
        names = known.column("names")[0].values if known.num_rows else pa.array([], pa.string())
        where = [pa.compute.index_in(asked.column("asked")[i].values, names).fill_null(-1).to_numpy()
                 for i in range(asked.num_rows)]
        return pa.table([asked.column("block"), asked.column("g"), pa.array([_bytes(w, np.int32) for w in where], pa.binary())],
                        names=["block", "g", "at"])

    schema = _schema(PACKED, raw.schema["docs"])

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("g").to_numpy())
        at = np.concatenate([np.frombuffer(found.column("at")[int(i)].as_py(), np.int32) for i in order])
        group = np.repeat(_list(block.column("groups")), _list(block.column("sizes")))
        d, t, x = _cells(block)
        held = at >= 0
        mine, place = held[t], np.cumsum(held) - 1
        lengths = np.bincount(d[mine], minlength=len(block.column("docs")[0].values))
        docs = block.column("docs")[0].values.filter(pa.array(lengths > 0))
        if not len(docs):
            return pa.Table.from_batches([_row(schema, 0, docs, [], [], b"", b"", b"", b"")]).slice(0, 0)
        groups, sizes = np.unique(group[held], return_counts=True)
        return pa.Table.from_batches([_row(
            schema, block.column("block")[0].as_py(), docs, groups, sizes, _bytes(at[held], np.int32),
            _bytes(lengths[lengths > 0], np.int32), _bytes(place[t[mine]], np.int32), _bytes(x[mine], float))])

    asked = raw.select("block", "names", "groups", "sizes").mapInArrow(slices, "g int, block long, asked array<string>")
    found = terms.select("g", "names").groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(find, "block long, g int, at binary")
    return stored(raw.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema), name)


def plan(packed: DataFrame, name: str) -> DataFrame:
    """(g, blocks, at): the blocks that have terms of a group and, for each, their positions in it."""
    def slices(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, groups, sizes = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values.to_numpy()
                at = np.frombuffer(batch.column(3)[i].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([
                    groups.cast(pa.int32()), pa.array(np.full(len(groups), block)),
                    pa.array([_bytes(p, np.int32) for p in np.split(at, np.cumsum(sizes)[:-1])], pa.binary())],
                    names=["g", "block", "at"])

    rows = packed.select("block", "groups", "sizes", "at").mapInArrow(slices, "g int, block long, at binary")
    return stored(rows.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "at"))).alias("r")).select(
        "g", F.col("r.block").alias("blocks"), F.col("r.at").alias("at")), name)


def batches(packed: DataFrame, rounds: Column, name: str) -> DataFrame:
    """(round, block, ``PACKED``) of the documents in a round's batch; ``rounds`` is, for
    every one of the ``docs``, an array of the rounds that take it."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                takes, lengths = row.column("rounds")[0].values, _values(row.column("lengths"), np.int32)
                d, t, x = _cells(row)
                at, sizes = _values(row.column("at"), np.int32), _list(row.column("sizes"))
                group = np.repeat(_list(row.column("groups")), sizes)
                taken = takes.flatten().to_numpy()
                doc = np.repeat(np.arange(len(takes)), takes.value_lengths().to_numpy())
                for r in np.unique(taken):
                    who = doc[taken == r]
                    mine = np.zeros(len(lengths), bool)
                    mine[who] = True
                    cells = mine[d]
                    held, place = np.unique(t[cells], return_inverse=True)
                    groups, own = np.unique(group[held], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *_row(
                        schema, row.column("block")[0].as_py(), groups, own, _bytes(at[held], np.int32),
                        _bytes(lengths[who], np.int32), _bytes(place, np.int32), _bytes(x[cells], float)).columns],
                        names=["round", *schema.names])

    schema = _schema("block long, " + PACKED)
    rows = packed.withColumn("rounds", rounds).drop("docs").mapInArrow(run, "round int, block long, " + PACKED)
    return stored(rows, name, "round")


def send(plan: DataFrame, state: DataFrame, k: int, rows: Callable = lambda f: f) -> DataFrame:
    """(block, g, rows): ``rows`` of the state (g, f) of a group, an array of k numbers a
    term, for the terms of each block."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                g, blocks, at = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values
                out = rows(np.reshape(batch.column(3)[i].values.to_numpy(), (-1, k)))
                for j in range(len(blocks)):
                    yield pa.RecordBatch.from_arrays([
                        blocks.slice(j, 1), pa.array([g], pa.int32()),
                        pa.array([_bytes(out[np.frombuffer(at[j].as_py(), np.int32)], float)], pa.binary())],
                        names=["block", "g", "rows"])

    held = plan.join(state.select("g", "f").hint("merge"), "g").select("g", "blocks", "at", "f")   # no broadcast by way of the driver
    return held.mapInArrow(run, "block long, g int, rows binary")


def each_block(packed: DataFrame, sent: DataFrame, step: Callable, own: DataFrame | None = None,
               plan: DataFrame | None = None, base: float = 0.0) -> DataFrame:
    """``ROUND`` rows of every block: ``step(d, t, x, rows, own)`` gets its cells, its terms'
    rows as ``sent`` and its row of ``own`` (block, f) or None; it yields (kind, array), a
    row per term for ``TERM``. Those are added up (from ``base``) per group by the ``plan``:
    an array with a row per term of the group, up to the last that a block has."""
    if own is not None:
        sent = sent.withColumn("f", F.lit(None).cast("array<double>")).unionByName(own.select(
            "block", F.lit(-1).alias("g"), F.lit(None).cast("binary").alias("rows"), "f"))

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        g = got.column("g").to_numpy()
        mine = [_list(got.column("f").slice(int(i), 1)) for i in np.flatnonzero(g < 0)]
        parts = [np.frombuffer(got.column("rows")[int(i)].as_py()) for i in np.argsort(g, kind="stable") if g[i] >= 0]
        sizes, number = _list(block.column("sizes")), block.column("block")[0].as_py()
        out: list[tuple] = []
        rows = np.concatenate(parts).reshape(int(sizes.sum()), -1)
        for kind, found in step(*_cells(block), rows, mine[0] if mine else None):
            if kind == TERM:
                split = np.split(found, np.cumsum(sizes)[:-1])
                out += [(TERM, int(i), number, _bytes(p, float), None) for i, p in zip(_list(block.column("groups")), split)]
            else:
                out.append((kind, number, number, None, np.ravel(found)))
        cols = list(zip(*out))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                        + [pa.array(cols[4], pa.list_(pa.float64()))], names=["kind", "id", "block", "rows", "f"])

    # dealt by number, as partitions that are merged by their bytes leave cores idle in long steps
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells, sent = (x.repartition(parts, "block") for x in (packed.select("block", "groups", "sizes", "lengths", "t", "x"), sent))
    done = cells.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(
        run, "kind int, id long, block long, rows binary, f array<double>")
    return done.select("kind", "id", "f") if plan is None else _added(done, plan, base)


def _added(done: DataFrame, plan: DataFrame, base: float) -> DataFrame:
    """``ROUND`` rows with those of ``TERM`` added up per group, in order of the blocks."""
    def run(key, where: pa.Table, got: pa.Table) -> pa.Table:
        if key[0].as_py() != TERM or not got.num_rows:
            return got.select(["kind", "id", "f"])
        blocks = _list(where.column("blocks"))
        at = [np.frombuffer(a.as_py(), np.int32) for a in where.column("at")[0].values]
        rows = got.column("rows").combine_chunks()
        numbers = got.column("block").to_numpy()
        total = None
        for i in np.argsort(numbers, kind="stable"):
            own = at[int(np.searchsorted(blocks, numbers[i]))]
            part = np.frombuffer(rows[int(i)].as_py()).reshape(len(own), -1)
            if total is None:
                total = np.full((1 + max(int(a.max()) for a in at), part.shape[1]), base)
            total[own] += part
        return pa.table([pa.array([TERM], pa.int32()), pa.array([key[1].as_py()], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, total.size], pa.int32()), pa.array(total.ravel()))],
                        names=["kind", "id", "f"])

    where = plan.select(F.lit(TERM).alias("kind"), F.col("g").cast("long").alias("id"), "blocks", "at")
    return where.groupBy("kind", "id").cogroup(done.groupBy("kind", "id")).applyInArrow(run, ROUND)


def of_groups(done: DataFrame) -> DataFrame:
    """(g, f) of a round's sums per term."""
    return done.where(F.col("kind") == TERM).select(F.col("id").cast("int").alias("g"), "f")


def of_blocks(done: DataFrame) -> DataFrame:
    """(block, f) of a round's factors."""
    return done.where(F.col("kind") == FACTORS).select(F.col("id").alias("block"), "f")


def start(names: str, k: int, value: Callable[[Column, int], Column]) -> Column:
    """An array with k numbers for each of the ``names``."""
    return F.flatten(F.transform(names, lambda x: F.array(*[value(x, i) for i in range(k)])))


def named(groups: DataFrame, names: str, name: str, f: str, k: int) -> DataFrame:
    """(``name``, ``f``): the k numbers of each of the ``names`` from the flat array f."""
    return groups.select(F.posexplode(names).alias("_pos", name), "f").select(
        name, F.slice("f", F.col("_pos") * k + 1, F.lit(k)).alias(f))


def mapped(groups: DataFrame, step: Callable) -> DataFrame:
    """``ROUND`` rows (kind, array) that ``step`` yields for the arrays of a group (g, f, ...),
    None where there is none."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [c[i].values.to_numpy() if c[i].is_valid else None for c in batch.columns[1:]]
                for kind, got in step(*arrays):
                    flat = np.ravel(got)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([kind], pa.int32()), batch.column(0).slice(i, 1).cast(pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, pa.float64()))],
                        names=["kind", "id", "f"])

    return groups.mapInArrow(run, ROUND)


def summed(groups: DataFrame, k: int, step: Callable) -> np.ndarray:
    """Sum over the groups (g, f) of the array that ``step`` makes of f."""
    return np.array(by_position(mapped(groups.select("g", "f"), lambda f: [(TOTALS, step(np.reshape(f, (-1, k))))])))


def sums(index: np.ndarray, values: Iterable[np.ndarray], n: int) -> np.ndarray:
    """n rows: for each of the ``values`` a column of its sums per index."""
    return np.stack([np.bincount(index, v, n) for v in values], axis=1)


def by_position(rows: DataFrame) -> list[float]:
    """Sums of arrays of equal length, per position."""
    got = rows.select(F.posexplode("f").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [r["v"] for r in sorted(got)]
