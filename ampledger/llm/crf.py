"""A linear-chain conditional random field over dense features, in numpy.

Training takes whole chains, those of like length together; decoding takes one chain of any
length in linear time and memory. Labels are 0 and 1.
"""

from __future__ import annotations

import numpy as np

class Crf:
    """weights: (features, 2), moves: (from, to), first: (2,)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.moves, self.first, self.mean, self.scale = weights, moves, first, mean, scale

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        return self.decode(self.emissions(x)) if len(x) else np.zeros(0, int)

    def decode(self, emissions: np.ndarray) -> np.ndarray:
        """The best labels of one chain, from its (places, 2) emissions."""
        e, (m00, m01), (m10, m11) = emissions.tolist(), *self.moves.tolist()
        s0, s1 = e[0][0] + self.first[0], e[0][1] + self.first[1]
        back = []
        for e0, e1 in e[1:]:
            from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            s0, s1 = max(s0 + m00, s1 + m10) + e0, max(s0 + m01, s1 + m11) + e1
            back.append((from0, from1))
        out = [int(s1 > s0)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each place, by forward-backward; two log-odds recursions."""
        n = len(x)
        if n == 0:
            return np.zeros(0)
        e = self.emissions(x)
        d = (e[:, 1] - e[:, 0]).tolist()
        m = self.moves
        forward = [d[0] + float(self.first[1] - self.first[0])]
        for k in range(1, n):
            f = forward[-1]
            forward.append(d[k] + float(np.logaddexp(m[0, 1], f + m[1, 1]) - np.logaddexp(m[0, 0], f + m[1, 0])))
        backward = [0.0]
        for k in range(n - 1, 0, -1):
            g = backward[-1] + d[k]
            backward.append(float(np.logaddexp(m[1, 0], m[1, 1] + g) - np.logaddexp(m[0, 0], m[0, 1] + g)))
        odds = np.array(forward) + np.array(backward[::-1])
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def _batches(chains: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Chains of like length together: none is less than half as long as the longest of its batch."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for chain in sorted(chains, key=lambda c: -len(c[0])):
        if not out or 2 * len(chain[0]) < len(out[-1][0][0]):
            out.append([])
        out[-1].append(chain)
    return out


class _Batch:
    """Chains padded to the longest: features, labels and which places are real."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, scale: np.ndarray):
        b, t, f = len(chains), len(chains[0][0]), chains[0][0].shape[1]
        self.feats, self.gold, self.on = np.zeros((b, t, f)), np.zeros((b, t)), np.zeros((b, t), bool)
        for k, (x, y) in enumerate(chains):
            self.feats[k, : len(x)], self.gold[k, : len(x)], self.on[k, : len(x)] = (x - mean) / scale, y, True
        pairs, now, then = self.on[:, 1:], self.gold[:, 1:], self.gold[:, :-1]
        self.moves = np.array([[(pairs & (then == a) & (now == c)).sum() for c in (0, 1)] for a in (0, 1)], float)
        self.flat = self.feats.reshape(-1, f)

    def slopes(self, w: np.ndarray, moves: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Expected less observed counts of features by label, moves and first labels; by recursions on the log odds of label 1."""
        (m00, m01), (m10, m11) = moves
        d = (self.flat @ (w[:, 1] - w[:, 0])).reshape(self.gold.shape)
        ahead, behind = np.empty_like(d), np.zeros_like(d)
        ahead[:, 0] = d[:, 0] + first[1] - first[0]
        for k in range(1, d.shape[1]):
            f = ahead[:, k - 1]
            ahead[:, k] = d[:, k] + np.logaddexp(m01, f + m11) - np.logaddexp(m00, f + m10)
        for k in range(d.shape[1] - 2, -1, -1):
            g = behind[:, k + 1] + d[:, k + 1]
            behind[:, k] = np.where(self.on[:, k + 1], np.logaddexp(m10, m11 + g) - np.logaddexp(m00, m01 + g), 0.0)
        one = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
        off = (one - self.gold) * self.on
        side = off.reshape(-1) @ self.flat
        now = (behind + d)[:, 1:]
        logs = np.stack([np.full_like(now, m00), m01 + now, m10 + ahead[:, :-1], m11 + ahead[:, :-1] + now])
        pair = np.exp(logs - logs.max(axis=0))
        pair = (pair / pair.sum(axis=0) * self.on[:, 1:]).sum(axis=(1, 2)).reshape(2, 2)
        start = off[:, 0].sum()
        return [np.stack([-side, side], axis=1), pair - self.moves, np.array([-start, start])]


def train(chains: list[tuple[np.ndarray, np.ndarray]], l2: float = 1e-3, steps: int = 150, rate: float = 0.15) -> Crf:
    """Penalised likelihood by Adam on all chains at once. ``chains``: (features, labels) each; none give a neutral model."""
    chains = [(x, y) for x, y in chains if len(x)]
    if not chains:
        return Crf(np.zeros((1, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(1), np.ones(1))
    flat = np.concatenate([x for x, _ in chains])
    mean, scale = flat.mean(0), flat.std(0)
    mean, scale = np.where(scale > 1e-9, mean, 0.0), np.where(scale > 1e-9, scale, 1.0)  # constants stay: a bias
    batches, places = [_Batch(b, mean, scale) for b in _batches(chains)], len(flat)
    params = [np.zeros((flat.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        each = [b.slopes(*params) for b in batches]
        for i, p in enumerate(params):
            g = sum(e[i] for e in each) / places + l2 * p
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.99 * m2[i] + 0.01 * g * g
            params[i] = p - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(*params, mean, scale)
