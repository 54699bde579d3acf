"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes: A (a byte-level BPE vocabulary of ``tokenizers``)
sees a space and the text, B (a ``sentencepiece`` model) the text, before which it puts
a space itself. All tokens of both, as byte intervals, are sorted by start
(``lexsort``); with the running maximum of their ends (``maximum.accumulate``) a new
group breaks off where a start reaches it, that is where a token of A and one of B both
end. Every token of A in a group is linked with every one of B in it.

Both vocabularies cut before a space that stands between two other characters: A's
pre-tokeniser by rule, B because no piece of it holds a space behind another character
(checked when the model is read; else texts stay whole). So a text is a row of parts
(words behind a space) whose groups never reach over, and a task aligns each distinct
part once, all new parts of a batch in one sort, and keeps the outcome of repeated ones
(about CACHE_PARTS of them). That changes no result; without such spaces a text is one
part.

The count of an id pair is the number of documents (rows) that hold it linked. The
distinct links of each document are written out, so texts are encoded once. Tasks
count the pairs of their own documents, so the shuffle carries a row per pair and task
flush. The counts of the most frequent pairs, at most ``held``, whole steps of counts at
a time, go to the tasks; the others are joined by a shuffle, so none is lost.

Text null, empty, or with tokens whose joined bytes differ from space + text: zeros and
an empty digest. Null and repeated ids, repeated rows: row by row. Other columns are
ignored, whatever their names. Ties for the highest count of an A id all count as best.
A group of very many tokens is expanded by its distinct ids and their numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import written

CACHE_PARTS = 300_000
CACHE_CHARS = 1 << 23
BATCH_BYTES = 1 << 20
EXPAND = 1 << 20
FLUSH_PAIRS = 1 << 20
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_JOINED = re.compile(r"\s | \s")


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both vocabularies and the aligned parts of this worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_len = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int64)
        self.width = len(pieces)                                     # pair code = a * width + b
        self.span = len(self.a_bytes) * self.width
        words = [str(i).encode() for i in range(max(len(self.a_bytes), self.width))]
        self.decimal = [w + mark for w in words for mark in (b",", b"|", b";")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []                                 # groups of a part, each with ';' behind it
        self.sizes = np.zeros((0, 4), np.int64)                      # n_a, n_b, n_groups, n_links; n_a -1: bytes differ
        self.first = np.zeros(1, np.int64)                           # where a part's pairs begin in codes
        self.codes = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)                            # in how many texts of this worker
        self.chars = 0

    def cut(self, text: str) -> list[str]:
        """Parts of a text, each without the space before it."""
        if not self.cuttable:
            return [text]
        if text[0] == " " or text[-1] == " " or _JOINED.search(text):
            return _INNER_SPACE.split(text)
        return text.split(" ")

    def align(self, parts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """sizes, texts, first, codes and times (see ``forget``) of parts, by one sort."""
        a_ids = [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        b_ids = self.b.encode(parts, num_threads=1)
        for k, p in enumerate(parts):
            want = (" " + p).encode()
            if want != b"".join([self.a_bytes[i] for i in a_ids[k]]) \
                    or want != b"".join([self.b_bytes[i] for i in b_ids[k]]):
                a_ids[k], b_ids[k] = None, None
        n = len(parts)
        wrong = np.array([x is None for x in a_ids], bool)
        a_n, b_n = (np.array([len(x or ()) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.array([i for x in ids if x for i in x], np.int64) for ids in (a_ids, b_ids))
        if not len(a):
            sizes = np.zeros((n, 4), np.int64)
            sizes[wrong, 0] = -1
            return sizes, [b""] * n, np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        start = np.concatenate([a_end - self.a_len[a], b_end - self.b_len[b]])
        side = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(np.concatenate([a_end, b_end])[order])
        opens = np.ones(len(order), bool)
        opens[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(opens) - 1
        a_group, b_group = group[:len(a)], group[len(a):]
        groups = int(group.max()) + 1
        a_in, b_in = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        a_first, b_first = np.cumsum(a_in) - a_in, np.cumsum(b_in) - b_in
        part_of = np.empty(groups, np.int64)
        part_of[a_group] = np.repeat(np.arange(n), a_n)

        # groups as text: A's ids, '|', B's ids, ';'
        line = np.empty(len(group), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[a_first + a_in - 1], mark_b[b_first + b_in - 1] = 1, 2
        line[np.arange(len(a)) + b_first[a_group]] = a * 3 + mark_a
        line[np.arange(len(b)) + (a_first + a_in)[b_group]] = b * 3 + mark_b
        words = [self.decimal[x] for x in line.tolist()]
        ends = np.cumsum(a_n + b_n).tolist()
        texts = [b"".join(words[i:j]) for i, j in zip([0, *ends], ends)]

        links = a_in * b_in
        keys, times = [], []
        small = np.flatnonzero(links <= EXPAND)
        edge = np.searchsorted(np.cumsum(links[small]), np.arange(EXPAND, links[small].sum() + EXPAND, EXPAND))
        for some in np.split(small, np.unique(np.minimum(edge + 1, len(small)))):
            if len(some):
                each = np.repeat(some, links[some])
                k = np.arange(len(each)) - np.repeat(np.cumsum(links[some]) - links[some], links[some])
                x, t = np.unique(part_of[each] * self.span + a[a_first[each] + k // b_in[each]] * self.width
                                 + b[b_first[each] + k % b_in[each]], return_counts=True)
                keys.append(x)
                times.append(t)
        for g in np.flatnonzero(links > EXPAND):
            (ua, ca), (ub, cb) = (np.unique(ids[f[g]:f[g] + m[g]], return_counts=True)
                                  for ids, f, m in ((a, a_first, a_in), (b, b_first, b_in)))
            for i, c in zip(ua.tolist(), ca.tolist()):
                keys.append(part_of[g] * self.span + i * self.width + ub)
                times.append(cb * c)
        key, times = _summed(np.concatenate(keys), np.concatenate(times))
        part, code = np.divmod(key, self.span)
        first = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n))])
        sizes = np.stack([a_n, b_n, np.bincount(part_of, minlength=n),
                          np.bincount(part_of, links, n).astype(np.int64) if links.sum() < 1 << 50 else
                          np.array([int(links[part_of == k].sum()) for k in range(n)])], 1)
        sizes[wrong, 0] = -1
        return sizes, texts, first, code, times

    def learn(self, parts: list[str]) -> None:
        sizes, texts, first, codes, times = self.align(parts)
        self.known.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts))))
        self.texts += texts
        self.sizes = np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([self.first, first[1:] + len(self.codes)])
        self.codes, self.times = np.concatenate([self.codes, codes]), np.concatenate([self.times, times])
        self.used = np.concatenate([self.used, np.zeros(len(parts), np.int64)])
        self.chars += sum(map(len, parts))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """sizes (n, 4) and digests of texts; their distinct links as (text, code, times)."""
        sizes, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        if len(self.known) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self.drop()
        cuts = [self.cut(t) if t else [] for t in texts]
        new = list(dict.fromkeys(p for c in cuts for p in c if p not in self.known))
        if new:
            self.learn(new)
        flat = np.fromiter((self.known[p] for c in cuts for p in c), np.int64)
        edge = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(edge))
        bad = np.zeros(len(texts), bool)
        bad[doc[self.sizes[flat, 0] < 0]] = True
        for k in range(4):
            sizes[:, k] = np.bincount(doc, self.sizes[flat, k], len(texts)).astype(np.int64)
        of = flat.tolist()
        for k, c in enumerate(cuts):
            if c and not bad[k]:
                groups = b"".join([self.texts[i] for i in of[edge[k]:edge[k + 1]]])
                digests[k] = hashlib.sha256(memoryview(groups)[:-1]).hexdigest()
        ok = ~bad[doc]
        both, n = np.unique(doc[ok] * len(self.texts) + flat[ok], return_counts=True)
        d, p = np.divmod(both, max(1, len(self.texts)))
        self.used += np.bincount(p, minlength=len(self.texts))
        size = self.first[p + 1] - self.first[p]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[p], size)
        key, times = _summed(np.repeat(d, size) * self.span + self.codes[at], self.times[at] * np.repeat(n, size))
        sizes[bad] = 0
        more = []
        for k in np.flatnonzero(bad).tolist():  # whole: only the joined bytes count
            s, t, _, codes, many = self.align([texts[k]])
            if s[0, 0] > 0:
                sizes[k], digests[k] = s[0], hashlib.sha256(memoryview(t[0])[:-1]).hexdigest()
                more.append((k * self.span + codes, many))
        if more:
            key, times = _summed(np.concatenate([key, *(x for x, _ in more)]),
                                 np.concatenate([times, *(x for _, x in more)]))
        return sizes, digests, *np.divmod(key, self.span), times

    def drop(self) -> None:
        """Forget parts that one text used, and if that is not half of them, all."""
        again = self.used > 1
        keep = [p for p, i in self.known.items() if again[i]]
        if 2 * len(keep) > CACHE_PARTS or 2 * (chars := sum(map(len, keep))) > CACHE_CHARS:
            return self.forget()
        at = np.array([self.known[p] for p in keep], np.int64)
        size = self.first[at + 1] - self.first[at]
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[at], size)
        self.texts = [self.texts[i] for i in at.tolist()]
        self.sizes, self.codes, self.times = self.sizes[at], self.codes[rows], self.times[rows]
        self.first, self.used, self.chars = np.concatenate([[0], np.cumsum(size)]), self.used[at] // 2, chars
        self.known = {p: i for i, p in enumerate(keep)}


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


_ALIGNER: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNER:
        _ALIGNER.clear()
        _ALIGNER[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNER[a_path, b_path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of about BATCH_BYTES each."""
    for batch in batches:
        ids, texts, at, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= BATCH_BYTES or k + 1 == len(texts):
                yield ids[at:k + 1], texts[at:k + 1]
                at, size = k + 1, 0


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct links of each document: ``_codes``, the differences of sorted pair
    codes (A's id times the number of B's pieces plus B's id), and ``_times``, how often
    each occurs, both as little-endian 64-bit numbers; its sizes and digest."""
    def run(batches):
        work, seen, task = aligner(a_path, b_path), 0, TaskContext.get().partitionId() << 33
        for ids, texts in _slices(batches):
            sizes, digests, doc, code, times = work.documents(texts)
            edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
            step = np.diff(code, prepend=0)
            step[edge[:-1][np.diff(edge) > 0]] = code[edge[:-1][np.diff(edge) > 0]]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(sizes[:, k]) for k in range(4)), pa.array(digests),
                 pa.array(np.arange(seen, seen + len(texts)) + task),
                 *(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [
                     None, pa.py_buffer(edge * 8), pa.py_buffer(x.astype("<i8"))]).cast(pa.binary())
                   for x in (step, times))],
                [id_col, *COUNTS[:4], "groups_sha256", "_row", "_codes", "_times"])
            seen += len(texts)

    source = docs.select(F.col(id_col), F.col(text_col))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, "
                             + ", ".join(f"{c} long" for c in COUNTS[:4])
                             + ", groups_sha256 string, _row long, _codes binary, _times binary")


def _read(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column, and how many each row has."""
    values = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(values), "<i8"), np.array([len(v) // 8 for v in values], np.int64)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    step, n = _read(batch, "_codes")
    code = np.cumsum(step)
    first = np.cumsum(n) - n
    has = n > 0
    return code - np.repeat((code[first[has]] - step[first[has]]), n[has]), n


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, int(len(batch) * 8 * BATCH_BYTES / max(1, batch.nbytes)))
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def pair_counts(found: DataFrame) -> DataFrame:
    """``(code, n_docs)``: in how many documents of ``links`` (written) a pair is linked."""
    def run(batches):
        codes, counts = [], []

        def merge():
            c, n = _summed(np.concatenate(codes), np.concatenate(counts))
            codes[:], counts[:] = [c], [n]
            return c

        for batch in _by_size(batches):
            c, n = np.unique(_codes(batch)[0], return_counts=True)
            codes.append(c)
            counts.append(n)
            if sum(map(len, codes)) > 4 * FLUSH_PAIRS and len(merge()) > FLUSH_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(codes.pop()), pa.array(counts.pop())], ["code", "n"])
        if codes:
            merge()
            yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], ["code", "n"])

    return found.select("_codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_docs"))


def with_counts(found: DataFrame, pairs: DataFrame, width: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """The row of each document of ``links``; ``pairs`` are its counts (both written)."""
    spark = found.sparkSession
    top = pairs.withColumn("a", F.expr(f"code div {width}"))
    top = top.join(top.groupBy("a").agg(F.max("n_docs").alias("most")), "a") \
        .select("code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    # steps of an eighth of a doubling of the count, from the top, as long as they fit
    step = F.floor(F.log2("n_docs") * 8)
    steps = sorted(((r[0], r[1]) for r in pairs.groupBy(step).count().collect()), reverse=True)
    total, least = 0, None
    for s, n in steps:
        if total + n > held:
            break
        total, least = total + n, s
    rows = np.zeros((3, 0), np.int64)
    if total:
        rows = top.where(step >= least).selectExpr("code", "n_docs", "int(best) best").toPandas() \
            .sort_values("code").to_numpy(np.int64).T
    kept = spark.sparkContext.broadcast(rows)

    def run(batches):
        codes, n_docs, best = kept.value
        for batch in _by_size(batches):
            (code, n), times = _codes(batch), _read(batch, "_times")[0]
            doc = np.repeat(np.arange(len(batch)), n)
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            n_best, count_sum = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(n_best, doc[hit], times[hit] * best[at[hit]])
            np.add.at(count_sum, doc[hit], times[hit] * n_docs[at[hit]])
            edge = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(batch)))]).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x[~hit])) for x in (code, times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (id_col, *COUNTS[:4])), pa.array(n_best), pa.array(count_sum),
                 batch.column("groups_sha256"), batch.column("_row"), *rare],
                [id_col, *COUNTS, "groups_sha256", "_row", "_code", "_times"])

    kind = found.schema[id_col].dataType.simpleString()
    out = found.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
                           + ", groups_sha256 string, _row long, _code array<long>, _times array<long>")
    if total == sum(n for _, n in steps):
        return out.drop("_row", "_code", "_times")
    out = written(out, "alignment", compression="zstd")
    rare = out.select("_row", F.explode(F.arrays_zip("_code", "_times")).alias("x")).select("_row", "x.*")
    others = top if least is None else top.where(step < least)
    rare = rare.join(others, rare["_code"] == F.col("code")).groupBy("_row").agg(
        F.sum(F.col("_times") * F.col("best").cast("long")).alias("_best"),
        F.sum(F.col("_times") * F.col("n_docs")).alias("_sum"))
    return out.join(rare, "_row", "left").select(
        id_col, *COUNTS[:4], (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, held: int = 1 << 20, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: ids, numbers of tokens, groups and links, links that are
    the best of their A id, the sum of the links' counts, and the groups' digest."""
    found = written(links(docs, a_path, b_path, id_col, text_col), "links", compression="zstd")
    pairs = written(pair_counts(found), "pairs")
    return with_counts(found, pairs, aligner(a_path, b_path).width, held, id_col)


def groups(text: str, a_path: str, b_path: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, as lists of A's and B's ids (a look at single texts)."""
    sizes, texts, *_ = aligner(a_path, b_path).align([text]) if text else (np.zeros((1, 4)), [b""])
    return [tuple([int(x) for x in s.split(",")] for s in g.split("|"))
            for g in texts[0].decode().split(";") if g] if sizes[0, 0] > 0 else []
