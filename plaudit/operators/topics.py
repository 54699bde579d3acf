"""Topic models (2-F): online LDA (seed 42) and a non-negative matrix factorisation of
TF-IDF by multiplicative updates, both over blocks of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions import alpha_tokens
from plaudit import lexicons as L
from plaudit.operators import blocks as bl
from plaudit.operators.blocks import stored
from plaudit.operators.scan import top_n_per_group
from plaudit.operators.variational import _e_step, _runs, digamma, trigamma


def _docs(df: DataFrame, min_len: int = 20) -> DataFrame:
    """Reviews longer than ``min_len`` characters, alphabetic tokens minus stop words."""
    toks = F.filter(alpha_tokens("review"), lambda x: ~x.isin(L.STOP_WORDS_EN))
    return (df.where(F.length(F.coalesce("review", F.lit(""))) > min_len)
              .select("recommendation_id", "voted_up", toks.alias("tokens")))


def _worded(df: DataFrame) -> DataFrame:
    """The documents with tokens. Their condition names a column that it can't be moved
    below, where the tokens would be made twice."""
    docs = _docs(df).withColumn("_at", F.monotonically_increasing_id())
    return docs.where((F.size("tokens") > 0) & (F.col("_at") >= 0)).drop("_at")


MIN_DOCS = 10


def _kept(terms: DataFrame, n, min_df: float, max_df: float, vocab: int | None) -> DataFrame:
    """Of terms (term, df, n) those in at least ``min_df`` and at most ``max_df`` (a share) of
    ``n`` documents; ``vocab`` keeps only the most frequent ones when it is given."""
    out = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return out if vocab is None else out.orderBy(F.desc("n"), "term").limit(vocab)


def lda_blocks(docs: DataFrame, min_df: float, max_df: float, vocab: int | None = None
               ) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of the documents (_row, tokens) with the kept terms (see ``_kept``), these in
    groups (g, names), and the number of groups."""
    n, groups, size = bl.shape(docs)
    raw = bl.gather(docs, "_row", "lda_raw", groups, size)
    terms = bl.in_groups(_kept(bl.term_counts(raw), n, min_df, max_df, vocab), "lda_terms")
    packed = bl.trim(raw, terms, "lda_blocks")
    bl.dropped(raw)
    return packed, terms, groups


def expect(d, t, n, beta, alpha) -> tuple[np.ndarray, np.ndarray, float]:
    """E step of a block: topic weights of its documents, expected counts per term, its part of the bound."""
    gammas, found, bound = [], np.zeros(beta.shape), 0.0
    for first, end in _runs(d):
        part = d[first:end] - d[first]
        gamma, stats, more = _e_step(beta, part, t[first:end], n[first:end], int(part[-1]) + 1, alpha)
        gammas.append(gamma)
        found += bl.sums(t[first:end], stats.T, len(beta))
        bound += more
    return np.concatenate(gammas), found, bound


class OnlineLda:
    """A fitted model: terms in ``groups`` groups (g, names), the ``state`` (g, f) with k
    weights a term, ``topics`` (term, weights) of both, and ``alpha``, a document's prior
    weight of each topic. ``packed`` are the blocks of the documents that it was fitted on."""

    def __init__(self, terms: DataFrame, state: DataFrame, groups: int, alpha: np.ndarray, k: int, packed: DataFrame):
        self.terms, self.state, self.groups, self.alpha, self.k, self.packed = terms, state, groups, alpha, k, packed
        self.topics = bl.named(terms.join(state.hint("merge"), "g"), "names", "term", "weights", k)

    def e_step(self, packed: DataFrame, plan: DataFrame, last: bool) -> DataFrame:
        """Rows of every block: with ``last`` its documents' topic shares, else per term the
        expected counts, and the sums of the documents' mean log shares, then their number."""
        alpha, total = self.alpha, bl.summed(self.state, self.k, lambda f: f.sum(axis=0))

        def step(d, t, n, beta, own):
            gamma, found, _ = expect(d, t, n, beta, alpha)
            if last:
                yield bl.FACTORS, gamma / gamma.sum(axis=1)[:, None]
            else:
                shares = digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]
                yield bl.TOTALS, np.append(shares.sum(axis=0), len(gamma))
                yield bl.TERM, found

        sent = bl.send(plan, self.state, self.k, lambda f: np.exp(digamma(f) - digamma(total)))
        return bl.each_block(packed, sent, step, plan=None if last else plan)


def _new_alpha(alpha: np.ndarray, shares: np.ndarray, rate: float) -> np.ndarray:
    """A Newton step of size ``rate`` for the prior, by the mean log shares of a batch; none
    where a weight would not stay positive."""
    gradient = digamma(alpha.sum()) - digamma(alpha) + shares
    q = -trigamma(alpha)
    b = (gradient / q).sum() / (1 / trigamma(alpha.sum()) + (1 / q).sum())
    new = alpha - rate * (gradient - b) / q
    return new if (new > 0).all() else alpha


#: of Spark ML's online LDA: share of the documents in a round's batch, decay of the rounds' weight
BATCH, TAU, KAPPA = 0.05, 1024.0, 0.51


def fit_lda(df: DataFrame, k: int = 10, max_iter: int = 10, vocab: int | None = None,
            min_df: float = 2.0, max_df: float = 0.95, seed: int = 42):
    """Online variational Bayes (Hoffman, Blei, Bach) with the batches, rates and priors of
    Spark ML's online LDA, and the topics as a table: terms in at least ``min_df`` documents
    and at most the share ``max_df`` of them, all of them unless ``vocab`` cuts them. Round r
    takes a batch of about the share BATCH of the documents (by a hash of document, seed and
    round), and its terms' expected counts, as those of the whole corpus, enter the topics
    with weight (TAU + r) ^ -KAPPA. The batches of all rounds are cut from the blocks in one
    pass. The driver sees k totals and the prior's k sums a round.
    Returns (model, docs), or (None, docs) with fewer than 10 documents that have words."""
    docs = stored(_worded(df).withColumn("_row", F.monotonically_increasing_id()), "lda_docs")
    if len(docs.select("_row").limit(MIN_DOCS).collect()) < MIN_DOCS:
        return None, docs
    packed, terms, groups = lda_blocks(docs, min_df, max_df, vocab)
    size = packed.agg(F.sum(F.size("docs"))).first()[0]
    first = bl.start("names", k, lambda x, t: 1 + 0.35 * (F.pmod(F.xxhash64(x, F.lit(t), F.lit(seed)), F.lit(1_000_003))
                                                          / 1_000_003.0 - 0.5))   # mean 1, deviation 0.1
    model = OnlineLda(terms, stored(terms.select("g", first.alias("f")), "lda_topics"), groups, np.full(k, 1 / k), k, packed)
    packed.docs_at = docs.stored_at
    if not max_iter:
        return model, docs
    numbers = F.array(*[F.lit(r) for r in range(1, max_iter + 1)])
    parts = bl.batches(packed, F.transform("docs", lambda x: F.filter(numbers, lambda r: F.pmod(
        F.xxhash64(x, F.lit(seed), r), F.lit(1_000_003)) < F.lit(BATCH * 1_000_003))), "lda_batches")
    last = None
    for r in range(1, max_iter + 1):
        batch = parts.where(F.col("round") == r).drop("round")
        plan = bl.plan(batch, "lda_plan")
        done = stored(model.e_step(batch, plan, False), "lda_round")
        sums = np.array(bl.by_position(done.where(F.col("kind") == bl.TOTALS)))
        if len(sums):   # else no document in the batch
            rate, times = (TAU + r) ** -KAPPA, size / sums[-1]

            def enter(f, found, rate=rate, times=times):
                new = f * (1 - rate) + rate / k
                if found is not None:
                    new[:len(found)] += rate * times * found
                yield bl.TERM, new

            both = model.state.join(bl.of_groups(done).withColumnRenamed("f", "found").hint("merge"), "g", "left")
            new = stored(bl.mapped(both.select("g", "f", "found"), enter), "lda_topics")
            model = OnlineLda(terms, bl.of_groups(new), groups, _new_alpha(model.alpha, sums[:-1] / sums[-1], rate), k, packed)
            bl.dropped(last)
            last = new
        bl.dropped(done, plan)
    bl.dropped(parts)
    return model, docs


def topic_terms(model, n: int = 10) -> DataFrame:
    """Top ``n`` terms per topic by weight (ties by term), their share of the topic and
    the topic's label 'Topic i: w1, ..., w5' (i from 1)."""
    long = model.topics.select("term", F.posexplode("weights").alias("topic", "w"))
    total = long.groupBy("topic").agg(F.sum("w").alias("total"))
    top = top_n_per_group(long, ["topic"], [F.col("w").desc(), F.col("term")], n, "rank").join(total, "topic")
    return with_label(top.select("topic", (F.col("rank") - 1).alias("pos"), "term",
                                 (F.col("w") / F.col("total")).alias("weight")))


def with_label(terms: DataFrame) -> DataFrame:
    """Adds the topic's label 'Topic i: w1, ..., w5' (i from 1) to its ranked terms."""
    names = terms.where("pos < 5").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    label = F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string"), F.lit(": "),
                     F.array_join(F.transform("t", lambda x: x["term"]), ", "))
    return terms.join(names.select("topic", label.alias("label")), "topic")


def document_topics(model: OnlineLda, docs: DataFrame) -> DataFrame:
    """Topic mixture per document (recommendation_id, voted_up, tokens) and its dominant
    topic (arg max). Without a term of the model the mixture is zeros, the topic 0."""
    k, packed = model.k, model.packed
    if getattr(docs, "stored_at", None) != packed.docs_at:   # not those of the fit
        docs = stored(docs.withColumn("tokens", F.filter("tokens", F.isnotnull))
                      .withColumn("_row", F.monotonically_increasing_id()), "lda_docs")
        raw = bl.gather(docs, "_row", "lda_raw", model.groups, bl.shape(docs)[2])
        packed = bl.trim(raw, model.terms, "lda_blocks")
        bl.dropped(raw)
    own = stored(model.e_step(packed, plan := bl.plan(packed, "lda_plan"), True), "lda_shares")
    bl.dropped(plan)
    shares = bl.named(packed.select("block", "docs").join(bl.of_blocks(own), "block"), "docs", "_row", "mixture", k)
    out = docs.join(shares, "_row", "left").withColumn(
        "mixture", F.coalesce("mixture", F.array(*[F.lit(0.0)] * k)))
    return out.select("recommendation_id", "voted_up", "mixture",
                      (F.array_position("mixture", F.array_max("mixture")) - 1).alias("dominant_topic"))


def topic_summary(doc_topics: DataFrame) -> DataFrame:
    """Reviews and positive ratio per dominant topic."""
    return doc_topics.groupBy("dominant_topic").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col("voted_up").cast("double")).alias("positive_ratio"))


def _idf(n) -> Column:
    return F.log((n + 1) / (F.col("df") + 1)) + 1


def tfidf_cells(df: DataFrame, min_df: float = 2.0, max_df: float = 0.95, vocab: int | None = None) -> DataFrame:
    """(doc, term, w): TF-IDF with smoothed idf, unit length per document, only the
    cells that are not zero. Documents are named by their review id."""
    docs = _worded(df)
    n = docs.agg(F.count(F.lit(1))).scalar()
    tf = (docs.select(F.col("recommendation_id").alias("doc"), F.explode("tokens").alias("term"))
          .groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf = _kept(tf.groupBy("term").agg(F.count("doc").alias("df"), F.sum("tf").alias("n")), n, min_df, max_df, vocab).select(
        "term", _idf(n).alias("idf"))
    cells = tf.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("x"))
    size = cells.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return cells.join(size, "doc").select("doc", "term", (F.col("x") / F.col("size")).alias("w"))


def tfidf_blocks(df: DataFrame, min_df: float, max_df: float, vocab: int | None) -> tuple[DataFrame, DataFrame]:
    """The same as counts in blocks of documents (see ``blocks``), and the terms in groups
    (g, names, idf). A review id that comes more than once names one document, as above;
    those rows alone are grouped by id."""
    docs = stored(_worded(df).select(F.col("recommendation_id").alias("doc"), "tokens"), "nmf_docs")
    n, groups, size = bl.shape(docs)
    one = docs.where("doc is not null")
    twice = one.groupBy("doc").count().where("count > 1").select("doc")
    if twice.isEmpty():
        raw = parts = [bl.gather(one, "doc", "nmf_raw", groups, size)]
    else:
        twice = stored(twice, "nmf_twice")
        counts = stored(one.join(twice, "doc", "left_semi").select("doc", F.explode("tokens").alias("term"))
                        .groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")), "nmf_counts")
        raw = [bl.gather(one.join(twice, "doc", "left_anti"), "doc", "nmf_raw", groups, size),
               bl.pack(counts, "doc", "tf", "nmf_raw", size, groups=groups)]
        parts = [*raw, twice, counts]
    both = raw[0] if len(raw) == 1 else raw[0].unionByName(raw[1])
    kept = _kept(bl.term_counts(both), n, min_df, max_df, vocab).select("g", "term", _idf(F.lit(n)).alias("idf"))
    terms = bl.in_groups(kept, "nmf_terms", "idf")
    packed = bl.trim(both, terms, "nmf_blocks")
    bl.dropped(docs, *parts)
    return packed, terms


def _weights(d, t, n, idf) -> np.ndarray:
    """TF-IDF of a block's cells, unit length per document."""
    x = n * idf[t]
    return x / np.sqrt(np.bincount(d, x * x))[d]


def _start(name: Column, i: int, seed: int, level: float) -> Column:
    """Positive start value that depends on the row's name alone."""
    return (F.pmod(F.xxhash64(name, F.lit(seed + i)), F.lit(1 << 20)) / float(1 << 20) + 0.1) * level


def _gram(factors: DataFrame, k: int) -> list[list[float]]:
    """k x k sums of products of a factor's columns."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = factors.agg(*[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    return [[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]


def _round(packed: DataFrame, plan: DataFrame, w: DataFrame, h: DataFrame, gram: np.ndarray, k: int) -> DataFrame:
    """One multiplicative step for the documents with the terms ``h`` (g, f: k factors and
    the idf of each) held, and what the terms' own step needs of it: per block the new
    factors, their products' sums, and per term the sums of cells times factors."""
    def step(d, t, n, rows, own):
        x, rows, w = _weights(d, t, n, rows[:, k]), np.ascontiguousarray(rows.T), own.reshape(-1, k)
        num = bl.sums(d, (x * rows[i][t] for i in range(k)), len(w))
        w = w * num / (w @ gram + 1e-12)
        yield bl.FACTORS, w
        yield bl.TOTALS, w.T @ w
        yield bl.TERM, bl.sums(t, (x * w[d, i] for i in range(k)), rows.shape[1])

    return stored(bl.each_block(packed, bl.send(plan, h, k + 1), step, w, plan), "nmf_round")


def _terms_step(h: DataFrame, done: DataFrame, gram: np.ndarray, k: int) -> DataFrame:
    """One multiplicative step for the terms after a round of the documents, stored; with
    it the sums of the new factors' products and of <X, WH> with them."""
    def step(f, num):
        f, num = f.reshape(-1, k + 1), num.reshape(-1, k)
        new = f[:, :k] * num / (f[:, :k] @ gram + 1e-12)
        yield bl.TERM, np.concatenate([new, f[:, k:]], axis=1)
        yield bl.TOTALS, np.append(new.T @ new, (new * num).sum())

    both = h.join(bl.of_groups(done).withColumnRenamed("f", "num").hint("merge"), "g").select("g", "f", "num")
    return stored(bl.mapped(both, step), "nmf_terms")


def nmf_error(cells: DataFrame, w: DataFrame, h: DataFrame, k: int) -> float:
    """Squared error of the whole matrix, zeros included: |X|^2 - 2 <X, WH> + <W'W, HH'>."""
    x2, cross = (cells.join(w.withColumnRenamed("f", "fw"), "doc").join(h.withColumnRenamed("f", "fh"), "term")
                 .agg(F.sum(F.col("w") * F.col("w")), F.sum(F.col("w") * sum(
                     (F.col("fw")[i] * F.col("fh")[i] for i in range(k)), F.lit(0.0)))).first())
    a, b = _gram(w, k), _gram(h, k)
    return x2 - 2 * cross + sum(a[i][j] * b[i][j] for i in range(k) for j in range(k))


def fit_nmf(df: DataFrame, k: int = 10, max_iter: int = 200, vocab: int | None = None, seed: int = 42,
            tolerance: float = 1e-3):
    """Non-negative factorisation of the TF-IDF matrix by multiplicative updates, all
    cells in the loss, until a round lowers the error by less than ``tolerance`` of what
    it is (or ``max_iter`` rounds). Cells lie in blocks of documents (see ``blocks``): a
    round is one pass over the blocks with their terms' factors and a sum per term, which
    also gives the error; the driver sees k x k matrices. Factors are written after every
    step, those of the step before removed. Returns (term factors, document factors, cells),
    or (None, None, cells) with fewer than 10 documents that have words."""
    cells = tfidf_cells(df, vocab=vocab)
    packed, terms = tfidf_blocks(df, 2.0, 0.95, vocab)
    if (packed.agg(F.sum(F.size("docs"))).first()[0] or 0) < MIN_DOCS:
        return None, None, cells
    plan = bl.plan(packed, "nmf_plan")

    def measure(d, t, n, idf, own):
        x = _weights(d, t, n, idf[:, 0])
        yield bl.TOTALS, np.array([x.sum(), x @ x, len(x)])

    total, x2, number = bl.by_position(bl.each_block(
        packed, bl.send(plan, terms.select("g", F.col("idf").alias("f")), 1), measure))
    mean = total / number or 1.0
    w = stored(packed.select("block", bl.start("docs", k, lambda x, i: _start(x, i, seed, mean)).alias("f")), "nmf_docs")
    f = F.flatten(F.zip_with("names", "idf", lambda x, y: F.array(*[_start(x, i, seed + k, mean) for i in range(k)], y)))
    h = stored(terms.select("g", f.alias("f")), "nmf_terms")
    held = bl.summed(h, k + 1, lambda f: f[:, :k].T @ f[:, :k]).reshape(k, k)
    last, past = None, (w, h)
    for _ in range(max_iter):
        done = _round(packed, plan, w, h, held, k)
        mine = np.reshape(bl.by_position(done.where(F.col("kind") == bl.TOTALS)), (k, k))
        new = _terms_step(h, done, mine, k)
        w, h = bl.of_blocks(done), bl.of_groups(new)
        bl.dropped(*past)
        past = done, new
        *products, cross = bl.by_position(new.where(F.col("kind") == bl.TOTALS))
        held = np.reshape(products, (k, k))
        error = x2 - 2 * cross + (mine * held).sum()
        if last is not None and last - error < tolerance * last:
            break
        last = error
    bl.dropped(plan)
    w = bl.named(packed.select("block", "docs").join(w, "block"), "docs", "doc", "f", k)
    h = bl.named(terms.join(h.hint("merge"), "g"), "names", "term", "f", k + 1)
    return h.select("term", F.slice("f", 1, k).alias("f")), w, cells


def nmf_topic_terms(terms: DataFrame, n: int = 10) -> DataFrame:
    """Top n terms per factor, of weights that sum to one per factor (ties: term)."""
    f = terms.select("term", F.posexplode("f").alias("topic", "x"))
    total = f.groupBy("topic").agg(F.sum("x").alias("total"))
    top = top_n_per_group(f, ["topic"], [F.col("x").desc(), F.col("term")], n, "_r")
    return with_label(top.join(total, "topic").select("topic", (F.col("_r") - 1).alias("pos"), "term",
                                                      (F.col("x") / F.col("total")).alias("weight")))
