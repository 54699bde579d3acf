"""Language model, token counts, packing, chat formatting against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from plaudit.llm import bm25_packing, chat_format, hmm_lm, trie_tokens
from plaudit.llm.common import components, id_bucket


def plain_forward(seq, m):
    """Unscaled forward recursion of one sequence."""
    a = m["init"] * m["emit"][seq[0]]
    for c in seq[1:]:
        a = (a @ m["trans"]) * m["emit"][c]
    return math.log(a.sum())


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(3)
    return hmm_lm.start_model(rng.random(20), 3)


def test_forward_is_exact(small_model):
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 20, n).astype(np.uint16) for n in (1, 5, 17, 40, 2, 40)]
    got = hmm_lm.forward(np.concatenate(seqs), np.array([len(s) for s in seqs]), small_model)
    assert np.allclose(got, [plain_forward(s, small_model) for s in seqs])


def test_expected_counts_match_all_paths(small_model):
    from itertools import product
    seqs = [np.array([3, 4, 4], np.uint16), np.array([1, 2], np.uint16)]
    init, move, em, ll = hmm_lm.expected_counts(np.concatenate(seqs), np.array([3, 2]), small_model)
    i2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))
    total = 0.0
    for s in seqs:
        p = {}
        for path in product(range(3), repeat=len(s)):
            w = small_model["init"][path[0]] * small_model["emit"][s[0], path[0]]
            for a, b, c in zip(path, path[1:], s[1:]):
                w *= small_model["trans"][a, b] * small_model["emit"][c, b]
            p[path] = w
        z = sum(p.values())
        total += math.log(z)
        for path, w in p.items():
            i2[path[0]] += w / z
            for a, b in zip(path, path[1:]):
                m2[a, b] += w / z
            for c, k in zip(s, path):
                e2[c, k] += w / z
    assert np.allclose(init, i2, atol=1e-5) and np.allclose(move, m2, atol=1e-5)
    assert np.allclose(em, e2, atol=1e-5) and abs(ll - total) < 1e-4


def test_windows_cover_everything():
    got = hmm_lm.windows(np.empty(0), np.array([5, 10, 3, 11]), 5)
    assert got.tolist() == [5, 5, 5, 3, 5, 5, 1]


def test_base_score_and_gain(docs):
    rows = docs.select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in hmm_lm.score_texts(docs, id_bucket("doc_id", 7) == 2, head_words=50).collect()}
    assert len(out) == len(rows)
    c = Counter()
    toks = {}
    for r in rows:
        t = (r["text"] or "").encode().lower().split() + [b"\n"]
        toks[r["doc_id"]] = t
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for d, t in toks.items():
        o = out[d]
        assert o["train_tokens"] == n and o["n_tokens"] == len(t) and o["n_known"] == sum(w in c for w in t)
        assert o["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(o["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [o for o in out.values() if o["held_out"]]
    assert sum(o["score"] for o in held) > sum(o["base_score"] for o in held)


def test_class_model_is_a_distribution(spark):
    """All one-word continuations of the model sum to one: words seen, and one unseen
    type per class."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a a d", "b"])], "doc_id long, text string")
    out = hmm_lm.score_texts(df.unionByName(spark.createDataFrame([(99, "")], df.schema)), id_bucket("doc_id", 7) == 9,
                             own_classes=2, suffix_classes=2).collect()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_language_model_odd_rows(odd_docs, no_docs):
    got = hmm_lm.score_texts(odd_docs, id_bucket("doc_id", 7) == 2).collect()
    assert len(got) == 12 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 3] == [1]
    assert hmm_lm.score_texts(no_docs, id_bucket("doc_id", 7) == 2).count() == 0


def best_cut(word, vocab):
    """Plain Viterbi over one word."""
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        s, n = best[e - 1]
        options = [(s + size * trie_tokens.BYTE_COST, -(n + size))]
        options += [(best[a][0] + vocab[word[a:e]], -(best[a][1] + 1)) for a in range(e) if word[a:e] in vocab]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_token_counts(spark, docs, odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = trie_tokens.pieces(path)
    some = docs.where("length(text) < 4000")
    for df, words, kept in ((some, 200_000, 2_000_000), (some, 50, 3000), (odd_docs, 200_000, 2_000_000)):
        known = {}
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        want = Counter()
        for d, t in texts:
            ws = [trie_tokens.MARK + w for w in (t or "").split()]
            for w in ws:
                if w not in known:
                    known[w] = best_cut(w, vocab)
            want[d, len(ws), sum(known[w] for w in ws)] += 1
        got = {tuple(r) for r in trie_tokens.token_counts(df, path, words, kept).collect()}
        assert got == set(want)
    assert trie_tokens.token_counts(no_docs, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcé✓😀")), min_size=1, max_size=12), min_size=1, max_size=20),
       st.dictionaries(st.text(alphabet=st.sampled_from(list("abcé✓")), min_size=1, max_size=4),
                       st.floats(-9, -1), min_size=1, max_size=30))
def test_trie_equals_plain_search(words, vocab):
    trie = trie_tokens.Trie(vocab)
    got = trie.counts(words).tolist()
    assert got == [trie.count(w) for w in words]
    scores = lambda w: best_cut(w, vocab)
    assert got == [scores(w) for w in words]


def test_counts_agree_with_a_unigram_library():
    """The library's unigram model cuts words into as many pieces."""
    from tokenizers import Tokenizer, models
    vocab = trie_tokens.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    trie = trie_tokens.Trie(vocab)
    tok = Tokenizer(models.Unigram([("<unk>", -1000.0), *vocab.items()], 0, False))
    words = [trie_tokens.MARK + w for w in ("the", "tionthere", "hello", "internationalisation", "zzqx")]
    assert trie.counts(words).tolist() == [len(tok.encode(w).ids) for w in words]


def check_packing(docs_rows, pieces, window, ids_of):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for d, text in docs_rows:
        want = np.array([*ids_of(text or ""), 0], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert bytes(p["ids"]) == want[at:at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(want)
    pad = total = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        pad, total = pad + bm25_packing.padding(at, window), total + at
    return pad, total


def test_packing(spark, docs, bpe_ranks):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = bm25_packing.pack(docs, bpe_ranks, shard_rows=64).collect()
    pad, total = check_packing(rows, pieces, 1024, lambda t: tok.encode(t, add_special_tokens=False).ids)
    assert pad == 0 and total > 0


def test_packing_odd_rows(odd_docs, no_docs, bpe_ranks):
    one = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    enc = bm25_packing.bpe(bpe_ranks)
    pieces = bm25_packing.pack(one, bpe_ranks).collect()
    check_packing([(r["doc_id"], r["text"]) for r in one.collect()], pieces, 1024, enc.encoding.encode_ordinary)
    every = bm25_packing.pack(odd_docs, bpe_ranks).collect()
    assert sum(p["length"] for p in every) == sum(
        len(enc.encoding.encode_ordinary(r["text"] or "")) + 1 for r in odd_docs.collect())
    assert bm25_packing.pack(no_docs, bpe_ranks).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é's1.!\n\t  　✓<|")), max_size=40))
def test_cut_at_spaces_keeps_ids(text):
    enc = bm25_packing.bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert enc.ids(text) == np.array(enc.encoding.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "page", "é✓", "it's", "<"]),
                max_size=12))
def test_added_tokens_have_their_id(parts):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = bm25_packing.bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), path)
    tok = Tokenizer.from_file(path) if not hasattr(test_added_tokens_have_their_id, "tok") \
        else test_added_tokens_have_their_id.tok
    test_added_tokens_have_their_id.tok = tok
    for text in ("".join(parts), "end of page <|endoftext|> next page"):
        want = tok.encode(text, add_special_tokens=False).ids
        assert enc.ids(text) == np.array(want, "<u4").tobytes()
    assert 50256 in want and len(want) == 7


def test_shard_scores_are_bm25():
    rng = np.random.default_rng(0)
    tails = [rng.integers(0, 30, n) for n in (5, 40, 17, 60)]
    shard = bm25_packing.Shard(tails)
    avg = np.mean([len(t) for t in tails])
    for q in range(4):
        want = []
        for t in tails:
            s = 0.0
            for term in set(tails[q].tolist()):
                df = sum(term in x for x in tails)
                tf = (t == term).sum()
                s += math.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            want.append(s)
        assert np.allclose(shard.scores(q), want)


def test_neighbours_share_a_window(spark, bpe_ranks):
    """Texts of two vocabularies are not mixed while their own kind is left."""
    rng = np.random.default_rng(5)
    make = lambda ws: " ".join(rng.choice(ws, 200))
    a, b = [f"alpha{k}" for k in range(40)], [f"omega{k}" for k in range(40)]
    sizes = [300] * 40
    tails = [rng.integers(0, 100, 300) + (k % 2) * 1000 for k in range(40)]
    seqs, _, _ = bm25_packing.pack_shard(sizes, bm25_packing.Shard(tails), 1024)
    pure = sum(len({d % 2 for d, _, _ in s}) == 1 for s in seqs)
    assert pure >= len(seqs) - 3
    assert make(a) != make(b)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


def test_chat_formatting(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    odd = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
           (-8, 0, "assistant", None), (-8, 1, None, "x\\l<|end|>"), (-8, 1, None, "x\\l<|end|>"),
           (-9, None, "assistant", "é✓ \n <s>\\\\<<s>s>"), (-9, 5, "<|turn|>", "long " * 20000),
           (None, 1, "assistant", "a"), (None, 1, "assistant", "a")]
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    got = [tuple(r) for r in chat_format.digests(chat_format.format_conversations(rows, path)).collect()]
    convs = defaultdict(list)
    for r in rows.where("conv_id is not null").collect():
        convs[r["conv_id"]].append((r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or ""))
    want = {c: digest([x[2:] for x in sorted(ts, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))])
            for c, ts in convs.items()}
    assert {g[0]: g[1:5] for g in got if g[0] is not None} == want
    assert len(got) == len(want) + 2
    empty = rows.where("false")
    assert chat_format.format_conversations(empty, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>"]),
                          st.text(alphabet=st.sampled_from(list("<|>[]/INSTsendturx\\lb é✓\n ")), max_size=30)),
                max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    e = chat_format.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False)
    off = np.array(e.offsets, np.int64).reshape(-1, 2)
    mask, under = chat_format.align(off[:, 0], off[:, 1], spans)
    assert "".join(chat_format.unescape(text[a:b]) for a, b in under) == "".join(t for r, t in turns if r == "assistant")
    assert mask.sum() == sum(any(a < t and s < b for a, b in spans) for s, t in off.tolist())


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    edges += [(5000, k) for k in range(5001, 5200)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
