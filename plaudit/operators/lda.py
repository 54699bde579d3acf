"""Latent Dirichlet allocation by batch variational EM with the topics as a table.

Topics are a DataFrame ``(term, weights)``, a row of k numbers per term, so neither the
vocabulary nor the topic matrix is ever on the driver; it only sees k totals a round.
Documents lie in blocks (see ``blocks``): a round sends each block its terms' rows, the
E step iterates the topic weights of the block's documents together in the task, and a
row per term of the block goes into the sums per term. Each round is written to the
shared folder.

The evidence lower bound of a round is returned with it and never falls. The starting
weights come from a hash of term, topic and seed, so a fit is the same on any cluster.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.operators import blocks as bl
from plaudit.operators.blocks import stored
from plaudit.operators.topics import MIN_DOCS, _worded, expect, lda_blocks, topic_terms
from plaudit.operators.variational import _e_step, _lgamma, _runs, digamma  # noqa: F401


class TopicTable:
    """A fitted model: ``topics`` (term, weights), ``documents`` (recommendation_id,
    voted_up, topic_distribution), ``bounds``, one per round."""

    def __init__(self, topics: DataFrame, documents: DataFrame, bounds: list[float], k: int):
        self.topics, self.documents, self.bounds, self.k = topics, documents, bounds, k


def fit_lda_table(df: DataFrame, k: int = 10, rounds: int = 10, alpha: float | None = None, eta: float | None = None,
                  min_df: float = 2.0, max_df: float = 0.95, seed: int = 42) -> TopicTable | None:
    """Fit k topics on reviews of more than 20 characters; terms in at least ``min_df``
    documents and at most the share ``max_df`` of them. None with fewer than 10
    documents. Documents without a kept term get no distribution. Rows are documents of
    their own, repeated and null ids too."""
    alpha, eta = alpha or 1 / k, eta or 1 / k
    docs = stored(_worded(df).withColumn("_row", F.monotonically_increasing_id()), "lda_docs")
    if len(docs.select("_row").limit(MIN_DOCS).collect()) < MIN_DOCS:
        return None
    packed, terms, _ = lda_blocks(docs, min_df, max_df)
    start = bl.start("names", k, lambda x, t: eta + 0.5 + F.pmod(F.xxhash64(x, F.lit(t), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0)
    state = past = stored(terms.select("g", start.alias("f")), "lda_topics")
    plan = bl.plan(packed, "lda_plan")
    bounds: list[float] = []
    for last in [False] * rounds + [True]:
        sums = bl.summed(state, k, lambda f: np.append(f.sum(axis=0), len(f)))
        if not len(sums):
            break
        total, number = sums[:k], int(sums[k])

        def step(d, t, n, beta, own, last=last):
            gamma, found, bound = expect(d, t, n, beta, alpha)
            if last:
                yield bl.FACTORS, gamma / gamma.sum(axis=1)[:, None]
            else:
                yield bl.TOTALS, np.array([bound])
                yield bl.TERM, found

        sent = bl.send(plan, state, k, lambda f, total=total: np.exp(digamma(f) - digamma(total)))
        if last:
            own = stored(bl.each_block(packed, sent, step), "lda_round")
            shares = bl.named(packed.select("block", "docs").join(bl.of_blocks(own), "block"), "docs", "_row", "topic_distribution", k)
            out = stored(docs.join(shares, "_row").select("recommendation_id", "voted_up", "topic_distribution"), "lda_shares")
            bl.dropped(own, packed, plan, docs)
            return TopicTable(_topics(terms, state, k), out, bounds, k)
        done = stored(bl.each_block(packed, sent, step, plan=plan, base=eta), "lda_round")
        bounds.append(bl.by_position(done.where(F.col("kind") == bl.TOTALS))[0] + _topic_bound(state, total, number, eta, k))
        state = bl.of_groups(done)
        bl.dropped(past)
        past = done
    none = docs.limit(0).select("recommendation_id", "voted_up", F.array().cast("array<double>").alias("topic_distribution"))
    return TopicTable(_topics(terms, state, k), none, bounds, k)


def _topics(terms: DataFrame, state: DataFrame, k: int) -> DataFrame:
    return bl.named(terms.join(state.hint("merge"), "g"), "names", "term", "weights", k)


def _topic_bound(state: DataFrame, total: np.ndarray, terms: int, eta: float, k: int) -> float:
    """The topics' part of the bound, summed in the tasks."""
    base = digamma(total)
    part = bl.summed(state, k, lambda w: np.array([((eta - w) * (digamma(w) - base) + _lgamma(w) - math.lgamma(eta)).sum()]))
    return part[0] + sum(math.lgamma(terms * eta) - math.lgamma(t) for t in total.tolist())


lda_terms = topic_terms
