"""A linear-chain conditional random field with tags outside, begin and inside.

Emissions are sums of weights of hashed features; features of a token are worked out once per distinct
token. Training maximises the regularised log-likelihood, with gradients from the forward-backward
recursion over all sequences at once; decoding is Viterbi.
"""

from __future__ import annotations

import numpy as np

O, B, I = 0, 1, 2  # noqa: E741
NEVER = -1e4


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class LinearChain:
    """weights (features, 3), transitions (3, 3), start (3), and caution, what a caller takes from other tags than outside. Inside never follows outside nor starts a sequence."""

    def __init__(self, features: int):
        self.weights = np.zeros((features, 3))
        self.transitions = np.zeros((3, 3))
        self.start = np.zeros(3)
        self.caution = 0.0
        self.forbidden = np.zeros((3, 3))
        self.forbidden[O, I] = NEVER
        self.not_first = np.array([0, 0, NEVER])

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 250, rate: float = 0.03, penalty: float = 1e-4) -> LinearChain:
        """x (tokens, f) feature numbers of all tokens in turn, y (n, t) tags, mask (n, t) true where a token is. Adam on all sequences."""
        n, t = y.shape
        flat, many = x.ravel(), x.shape[1]
        onehot = np.eye(3)[y] * mask[..., None]
        pairs = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
        firsts = onehot[:, 0].sum(0)
        params = [self.weights, self.transitions, self.start]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            em = np.zeros((n, t, 3))
            em[mask] = self.weights[x].sum(1)
            tr, st = self.transitions + self.forbidden, self.start + self.not_first
            alpha, beta = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            alpha[:, 0] = st + em[:, 0]
            for k in range(1, t):
                new = _logsumexp(alpha[:, k - 1, :, None] + tr, 1) + em[:, k]
                alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
            for k in range(t - 2, -1, -1):
                new = _logsumexp(tr + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
            z = _logsumexp(alpha[:, -1], 1)
            gamma = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            both = np.zeros((3, 3))
            for k in range(1, t):
                p = alpha[:, k - 1, :, None] + tr + (em[:, k] + beta[:, k])[:, None, :] - z[:, None, None]
                both += (np.exp(p) * mask[:, k, None, None]).sum(0)
            off = np.repeat((onehot - gamma)[mask], many, 0)
            gw = np.stack([np.bincount(flat, off[:, k], len(self.weights)) for k in range(3)], 1)
            grads = [gw / n, (pairs - both) / n, (firsts - gamma[:, 0].sum(0)) / n]
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g - penalty * p
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                p += rate * (1 - 0.9 * step / steps) * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def margin(self) -> float:
        """A sequence is outside throughout if no token's other tags come nearer to outside than this.

        A run of k other tags has k + 1 transitions, 2k at most, each better than outside-outside by the
        largest difference at most."""
        best = max((self.transitions + self.forbidden).max(), (self.start + self.not_first).max() - self.start[O] + self.transitions[O, O])
        return 2 * max(0.0, best - self.transitions[O, O])

    def viterbi(self, em: np.ndarray) -> list[int]:
        """The best tags; of equally good ones the first. Plain floats, as three tags are too few for arrays."""
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = (self.transitions + self.forbidden).tolist()
        o, b, i = (self.start + self.not_first + em[0]).tolist()
        back = []
        for eo, eb, ei in em[1:].tolist():
            x, y, z = o + oo, b + bo, i + io
            to_o, at_o = (x, O) if x >= y and x >= z else (y, B) if y >= z else (z, I)
            x, y, z = o + ob, b + bb, i + ib
            to_b, at_b = (x, O) if x >= y and x >= z else (y, B) if y >= z else (z, I)
            x, y, z = o + oi, b + bi, i + ii
            to_i, at_i = (x, O) if x >= y and x >= z else (y, B) if y >= z else (z, I)
            o, b, i = to_o + eo, to_b + eb, to_i + ei
            back.append((at_o, at_b, at_i))
        tags = [O if o >= b and o >= i else B if b >= i else I]
        for places in reversed(back):
            tags.append(places[tags[-1]])
        return tags[::-1]
