"""Variational inference of topic weights: the E step of both forms of LDA."""

from __future__ import annotations

import math

import numpy as np

INNER, SETTLED = 100, 1e-5   # steps of a document's weights at most; mean change at which they stop
TOGETHER = 16_000   # cells of documents of like length that are stepped in one call


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: recurrence by ten steps, then Stirling's series."""
    x = np.asarray(x, float)
    low, y = np.zeros_like(x), x
    for _ in range(10):
        low = low + np.log(y)
        y = y + 1
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) - low \
        + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers: recurrence by ten steps (in pairs:
    1/x + 1/(x+9) and so on), then the asymptotic series."""
    x = np.asarray(x, float)
    pair = x * (x + 9)
    shift = 1 / pair
    for c in (8, 6, 4, 2):   # pair + 8, 14, 18, 20
        pair = pair + c
        shift = shift + 1 / pair
    shift = shift * (x + x + 9)
    y = x + 10
    r = 1 / (y * y)
    series = r / 132
    for c in (240, 252, 120, 12):
        series = (1 / c - series) * r
    return np.log(y) - (series + shift + 0.5 / y)


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``digamma`` for positive numbers, by the same steps."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):
        shift += 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    return shift + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def _log_shares(gamma: np.ndarray) -> np.ndarray:
    """Expected log share of each topic per document."""
    both = digamma(np.concatenate([gamma.T, gamma.sum(axis=1)[None]]))
    return (both[:-1] - both[-1]).T


def _alike(lengths: np.ndarray):
    """Sets of documents whose lengths differ by an eighth at most, ``TOGETHER`` cells or one document each."""
    order = np.argsort(lengths, kind="stable")
    ranked, first = lengths[order], 0
    while first < len(order):
        most = int(ranked[first])
        end = int(np.searchsorted(ranked, max(most + 2, most + most // 8), side="right"))
        end = max(first + 1, min(end, first + TOGETHER // max(1, int(ranked[end - 1]))))
        yield order[first:end]
        first = end


def _e_step(beta: np.ndarray, d: np.ndarray, t: np.ndarray, n: np.ndarray, docs: int, alpha
            ) -> tuple[np.ndarray, np.ndarray, float]:
    """Topic weights of a run of documents (cells in order of ``d``, from 0), expected
    counts of their cells, their part of the bound (0 where ``alpha`` is not one number but
    one per topic). A document's weights stay when its own mean change is small.

    Documents of like length are stepped together as matrices topics x cells, filled up by
    cells of count zero; those that have settled leave the matrices now and then."""
    k = beta.shape[1]
    lengths = np.bincount(d, minlength=docs)
    firsts = np.cumsum(lengths) - lengths
    gamma = alpha + np.repeat(np.bincount(d, n, docs)[:, None] / k, k, axis=1)
    stats, bound = np.empty((len(d), k)), 0.0
    for who in _alike(lengths):
        own = np.arange(lengths[who].max()) < lengths[who][:, None]
        cell = np.where(own, firsts[who][:, None] + np.arange(own.shape[1]), 0)
        count = np.where(own, n[cell], 0.0)
        at = np.ascontiguousarray(beta[t[cell]].transpose(0, 2, 1))
        now, live, lc, lat = gamma[who], np.arange(len(who)), count, at   # unsettled documents and their cells
        g, open_ = now, np.ones(len(who), bool)
        for _ in range(INNER):
            theta = np.exp(_log_shares(g))
            r = lc / (np.matmul(theta[:, None, :], lat)[:, 0, :] + 1e-300)
            new = alpha + theta * np.matmul(lat, r[:, :, None])[:, :, 0]
            new[~open_] = g[~open_]
            open_ = open_ & (np.abs(new - g).mean(axis=1) >= SETTLED)
            g, left = new, int(open_.sum())
            if left < 0.75 * len(open_):
                now[live] = g
                live, g, lc, lat, open_ = live[open_], g[open_], lc[open_], lat[open_], np.ones(left, bool)
            if not left:
                break
        now[live] = g
        gamma[who] = now
        log_theta = _log_shares(now)
        theta = np.exp(log_theta)
        mass = np.matmul(theta[:, None, :], at)[:, 0, :] + 1e-300
        stats[cell[own]] = (at * theta[:, :, None] * (count / mass)[:, None, :]).transpose(0, 2, 1)[own]
        if not np.ndim(alpha):
            bound += count[own] @ np.log(mass[own]) + ((alpha - now) * log_theta + _lgamma(now)).sum() \
                - _lgamma(now.sum(axis=1)).sum()
    if np.ndim(alpha):
        return gamma, stats, 0.0
    return gamma, stats, float(bound + docs * (math.lgamma(k * alpha) - k * math.lgamma(alpha)))


def _runs(d: np.ndarray, size: int = 500_000):
    """(first cell, end) of runs of whole documents of about ``size`` cells."""
    ends = np.r_[np.flatnonzero(d[1:] != d[:-1]) + 1, len(d)]
    first = 0
    while first < len(d):
        end = int(ends[np.searchsorted(ends, min(first + size, len(d)))])
        yield first, end
        first = end
