"""Small p x p solvers for fold-Gram fits (run per key inside grouped tasks).

Inputs are sufficient statistics -- n, sum x, sum y, sum x x^T, sum x y -- so a
fit costs O(p^3) no matter how many rows the key holds.  Intercepts are fitted
by centring, as the linear models with ``fit_intercept`` do.
"""

from __future__ import annotations

import numpy as np


def fit_batch(kind, N, SX, SY, SXX, SXY, active, alpha, scale=None, max_iter=10000, tol=1e-12):
    """Least squares (``ols``: minimum norm; ``ridge``: plus alpha ||w||^2; ``lasso``: (1/2n) of
    the squares plus alpha ||w||_1, by coordinate descent) over R stacked problems.

    N (R,), SX (R,p), SY (R,), SXX (R,p,p), SXY (R,p), active (R,p) bool.
    ``scale`` (R,p): the features are in units of it, while the penalties hold for the
    original units.  Inactive features get coefficient NaN.  Returns (b0 (R,), W (R,p)).
    """
    R, p = SX.shape
    Nn = np.where(N > 0, N, 1.0)
    mx = SX / Nn[:, None]
    my = SY / Nn
    G = SXX - Nn[:, None, None] * mx[:, :, None] * mx[:, None, :]
    c = SXY - Nn[:, None] * mx * my[:, None]
    act = active.astype(float)
    scale = np.ones((R, p)) if scale is None else scale
    G = G * act[:, :, None] * act[:, None, :]
    c = c * act
    if kind == "ols":
        W = np.einsum("rij,rj->ri", np.linalg.pinv(G), c)
    elif kind == "ridge":
        eye = np.eye(p)[None, :, :]
        W = np.linalg.solve(G + (alpha / scale ** 2 + 1.0 - act)[:, :, None] * eye, c[:, :, None])[:, :, 0]
    elif kind == "lasso":
        W = np.zeros((R, p))
        diag = np.einsum("rii->ri", G)
        thr = Nn[:, None] * alpha / scale
        for _ in range(max_iter):
            delta = np.zeros(R)
            for j in range(p):
                rho = c[:, j] - np.einsum("rk,rk->r", G[:, j, :], W) + diag[:, j] * W[:, j]
                safe = np.where(diag[:, j] > 0, diag[:, j], 1.0)
                new = np.where(diag[:, j] > 0, np.sign(rho) * np.maximum(np.abs(rho) - thr[:, j], 0.0) / safe, 0.0)
                delta = np.maximum(delta, np.abs(new - W[:, j]))
                W[:, j] = new
            if np.all(delta <= tol * np.maximum(1.0, np.abs(W).max(axis=1))):
                break
    else:
        raise ValueError(kind)
    b0 = my - np.einsum("rj,rj->r", mx, W)
    W = np.where(active, W, np.nan)
    b0 = np.where(N > 0, b0, np.nan)
    W[N <= 0] = np.nan
    return b0, W
