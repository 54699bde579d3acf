"""Cross-tokenizer alignment against the definition: common ends of byte intervals."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plaudit.llm import token_alignment
from plaudit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level():
    """The byte-level alphabet, from its definition: printable bytes first."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table, extra = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            table[chr(extra)] = b
            extra += 1
    return table


@pytest.fixture(scope="module")
def whole():
    """Groups of a text, encoded whole, by walking both cuts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    a.encode_special_tokens = True

    def run(text):
        if not text:
            return []
        x = a.encode(" " + text, add_special_tokens=False)
        y, x_ids = b.encode(text), x.ids
        x_bytes = [bytes(table[c] for c in t) for t in x.tokens]
        y_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in zip(y, map(b.id_to_piece, y))]
        if b"".join(x_bytes) != (" " + text).encode() or b"".join(y_bytes) != (" " + text).encode():
            return []
        out, i, j, ia, jb = [], 0, 0, [], []
        p = q = 0
        while i < len(x_ids) or j < len(y):
            if p <= q and i < len(x_ids):
                ia.append(x_ids[i])
                p += len(x_bytes[i])
                i += 1
            else:
                jb.append(y[j])
                q += len(y_bytes[j])
                j += 1
            if p == q:
                out.append((ia, jb))
                ia, jb = [], []
        return out
    return run


def brute(rows, whole):
    found = [(d, whole(t)) for d, t in rows]
    docs = Counter()
    for _, g in found:
        docs.update({(i, j) for a, b in g for i in a for j in b})
    most = {}
    for (i, _), n in docs.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for d, g in found:
        links = [(i, j) for a, b in g for i in a for j in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links),
                    sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", *token_alignment.COUNTS, "groups_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "a\n b \nc", "\t\n", "tab\tand  two   three    spaces",
       "<s>[INST] </s> <unk> <0x41> <|endoftext|>", "▁ literal mark", "x▁y z", "日本語のテキスト、改行\nつき", "🙂🙂 é É ﬁ ①",
       "nul\x00in", " nbsp   mixed　wide", "é combining", "don't I'll we've 's",
       "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 3.14159", "\x1c \x1d sep \x85", "\r\n \r\n", "﻿bom a"]


@pytest.mark.parametrize("held", [1 << 20, 500, 0])
def test_matches_whole_encoding(spark, docs, whole, held):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(None if k % 5 == 0 else 900 + k // 2, t) for k, t in enumerate(ODD * 2)] + [(7, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) \
        .select("*", F.lit(1).alias("n_a"), F.lit(2).alias("code"), F.lit("x").alias("groups_sha256"))
    assert got(token_alignment.align(df, A, B, held)) == brute(rows, whole)


def test_query(spark, whole):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op13_token_alignment"](spark, SF)) == brute(rows, whole)


def test_large_groups_and_flushes(spark, whole, monkeypatch):
    """Groups expanded by distinct ids, parts let go and met again."""
    rows = [(k, t) for k, t in enumerate([*ODD, "word " * 50, "longword" * 60, "x y z " * 30])]
    work = token_alignment.Aligner(A, B)
    plain = work.documents([t for _, t in rows])
    for name, value in (("EXPAND", 1), ("CACHE_PARTS", 30), ("CACHE_CHARS", 100)):
        monkeypatch.setattr(token_alignment, name, value)
    work = token_alignment.Aligner(A, B)
    for _ in range(2):
        again = work.documents([t for _, t in rows])
        assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(plain, again))


def test_long_text_without_spaces(spark):
    text = "あいうえおかきくけこ" * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = token_alignment.align(df, A, B).first()
    assert row["n_a"] > 0 and row["n_groups"] > 0 and len(row["groups_sha256"]) == 64


def test_empty_table(spark, no_docs):
    out = token_alignment.align(no_docs, A, B)
    assert out.columns == COLUMNS and out.count() == 0


def test_groups_of_one_text(whole):
    assert token_alignment.groups("unhappily  coalescing ﬁ", A, B) == whole("unhappily  coalescing ﬁ")
    assert token_alignment.groups("", A, B) == [] == token_alignment.groups("a▁b", A, B)
