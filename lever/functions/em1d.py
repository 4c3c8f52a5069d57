"""EM for one-dimensional Gaussian mixtures on bounded bin summaries.

A bin holds a count, a mean and a mean squared deviation about that mean, so no
step subtracts large squares.  Groups are padded to one array and fitted at once;
callers keep the number of cells bounded.
"""

from __future__ import annotations

import numpy as np

LOG_2PI = np.log(2.0 * np.pi)


def bic(ll_total, k, n):
    return -2.0 * ll_total + (3 * k - 1) * np.log(n)


def fit_gmm_1d_batch(n, m, v, k, reg_covar, max_iter=1000, tol=1e-3, init_iters=20):
    """Mixtures of ``k`` components for G groups of B bins; bins padded with n = 0.

    n, m, v: (G, B) counts, means and within-bin variances; reg_covar: (G,) or a
    number.  Returns weights, means, variances (G, k), total log likelihood (G,)
    and whether each group converged: its mean log likelihood changed by less than
    ``tol``, after which it is not updated any more.
    """
    n, m, v = (np.asarray(a, float) for a in (n, m, v))
    G, B = n.shape
    N = n.sum(1)
    reg = np.broadcast_to(np.asarray(reg_covar, float), (G,))[:, None]
    valid = n > 0
    m, v = np.where(valid, m, 0.0), np.where(valid, v, 0.0)
    # quantile start, then a few weighted Lloyd steps (deterministic)
    order = np.argsort(np.where(valid, m, np.inf), axis=1)
    ms = np.take_along_axis(m, order, 1)
    cw = np.cumsum(np.take_along_axis(n, order, 1), 1) / N[:, None]
    centers = np.stack([ms[np.arange(G), np.minimum((cw < (i + 0.5) / k).sum(1), B - 1)] for i in range(k)], 1)

    def nearest():
        lab = np.argmin(np.abs(m[:, :, None] - centers[:, None, :]), 2)
        return (lab[:, :, None] == np.arange(k)).astype(float)

    for _ in range(init_iters):
        oh = nearest() * n[:, :, None]
        wsum = oh.sum(1)
        new = np.where(wsum > 0, (oh * m[:, :, None]).sum(1) / np.where(wsum > 0, wsum, 1.0), centers)
        if np.array_equal(new, centers):
            break
        centers = new
    resp = nearest()
    wt, mu, var = np.zeros((G, k)), np.zeros((G, k)), np.ones((G, k))
    ll, prev, done = np.full(G, -np.inf), np.full(G, -np.inf), np.zeros(G, bool)
    eps10 = 10 * np.finfo(float).eps
    for _ in range(max_iter + 1):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        share = resp[at] * n[at][:, :, None]
        nk = share.sum(1) + eps10
        mu_a = (share * m[at][:, :, None]).sum(1) / nk
        dev = v[at][:, :, None] + (m[at][:, :, None] - mu_a[:, None, :]) ** 2
        var_a = (share * dev).sum(1) / nk + reg[at]
        wt_a = nk / N[at][:, None]
        logp = -0.5 * (LOG_2PI + np.log(var_a)[:, None, :] + dev / var_a[:, None, :]) + np.log(wt_a)[:, None, :]
        top = logp.max(2, keepdims=True)
        lse = top[:, :, 0] + np.log(np.exp(logp - top).sum(2))
        resp[at] = np.exp(logp - lse[:, :, None])
        wt[at], mu[at], var[at] = wt_a, mu_a, var_a
        prev[at], ll[at] = ll[at], np.where(valid[at], n[at] * lse, 0.0).sum(1)
        with np.errstate(invalid="ignore"):
            done[at] = np.abs(ll[at] - prev[at]) / N[at] < tol
    return wt, mu, var, ll, done
