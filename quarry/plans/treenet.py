"""A tree-convolution network in NumPy: scores plan trees; trained on pairs, on latencies or on rank scores.

Three convolutions over a node and its two children, a normalisation over all channels and nodes of a tree after each and a
leaky rectifier after the first two, a maximum over nodes, two dense layers. Trees of a batch are padded to the largest;
padding takes part in normalisation, so a plan's score depends on its batch: plans of a query are scored together.
A higher score means a slower plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

SLOPE, EPS = 0.01, 1e-5
WIDTHS, DENSE = (256, 128, 64), (32, 1)


class TreeError(ValueError):
    """Trees whose nodes have features of different lengths."""


class Tree(NamedTuple):
    feat: np.ndarray  # nodes in preorder x features
    left: np.ndarray  # preorder numbers from 1, 0: none
    right: np.ndarray


def tree(rows: list[tuple[int, int, int, list[float]]]) -> Tree:
    """A tree of (pre_idx, left, right, features) rows."""
    rows = sorted(rows, key=lambda r: r[0])
    if len({len(r[3]) for r in rows}) > 1:
        raise TreeError("nodes with features of different lengths")
    return Tree(np.array([r[3] for r in rows], float), np.array([r[1] for r in rows], int), np.array([r[2] for r in rows], int))


def batch(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Features (trees x 1 + nodes x features, row 0 zero) and indices (trees x nodes x 3) padded with 0."""
    widths = {t.feat.shape[1] for t in trees}
    if len(widths) > 1:
        raise TreeError("trees with features of different lengths")
    n = max(len(t.feat) for t in trees)
    x = np.zeros((len(trees), n + 1, widths.pop()))
    idx = np.zeros((len(trees), n, 3), int)
    for i, t in enumerate(trees):
        k = len(t.feat)
        x[i, 1 : k + 1] = t.feat
        idx[i, :k] = np.stack([np.arange(1, k + 1), t.left, t.right], axis=1)
    return x, idx


def init(n_features: int, seed: int = 0, widths: tuple[int, ...] = WIDTHS, dense: tuple[int, ...] = DENSE) -> list[np.ndarray]:
    """Weights and biases, uniform within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    out, sizes = [], [*((3 * a, b) for a, b in zip((n_features, *widths), widths)), *zip((widths[-1], *dense), dense)]
    for a, b in sizes:
        out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return out


def forward(params: list[np.ndarray], x: np.ndarray, idx: np.ndarray, n_conv: int = len(WIDTHS)) -> tuple[np.ndarray, np.ndarray, list]:
    """Scores, the pooled embedding and what backward needs."""
    b, n, _ = idx.shape
    rows = np.arange(b)[:, None, None]
    saved = []
    for k in range(n_conv):
        w, bias = params[2 * k], params[2 * k + 1]
        g = x[rows, idx].reshape(b, n, -1)
        y = np.concatenate([np.zeros((b, 1, w.shape[1])), g @ w + bias], axis=1)
        mean = y.mean(axis=(1, 2), keepdims=True)
        std = y.std(axis=(1, 2), ddof=1, keepdims=True)
        z = (y - mean) / (std + EPS)
        saved.append((g, x.shape, y - mean, std, z))
        x = np.where(z > 0, z, SLOPE * z) if k < n_conv - 1 else z
    top = x.argmax(axis=1)
    pooled = np.take_along_axis(x, top[:, None], 1)[:, 0]
    h, layers = pooled, []
    dense = (len(params) - 2 * n_conv) // 2
    for k in range(dense):
        w, bias = params[2 * (n_conv + k)], params[2 * (n_conv + k) + 1]
        a = h @ w + bias
        layers.append((h, a))
        h = np.where(a > 0, a, SLOPE * a) if k < dense - 1 else a
    return h[:, 0], pooled, [idx, saved, top, x.shape, layers]


def backward(params: list[np.ndarray], cache: list, d_score: np.ndarray, n_conv: int = len(WIDTHS)) -> list[np.ndarray]:
    """Gradients of the parameters from the gradient of the scores; without dense layers, of the embedding."""
    idx, saved, top, shape, layers = cache
    grads = [np.zeros_like(p) for p in params]
    d = d_score[:, None] if layers else d_score
    for k in range(len(layers) - 1, -1, -1):
        h, a = layers[k]
        if k < len(layers) - 1:
            d = d * np.where(a > 0, 1.0, SLOPE)
        at = 2 * (n_conv + k)
        grads[at], grads[at + 1] = h.T @ d, d.sum(0)
        d = d @ params[at].T
    dx = np.zeros(shape)
    np.put_along_axis(dx, top[:, None], d[:, None], 1)
    b, n, _ = idx.shape
    rows = np.arange(b)[:, None, None]
    for k in range(n_conv - 1, -1, -1):
        g, x_shape, centred, std, z = saved[k]
        if k < n_conv - 1:
            dx = dx * np.where(z > 0, 1.0, SLOPE)
        m = centred[0].size
        s = std + EPS
        dot = (dx * centred).sum(axis=(1, 2), keepdims=True)
        dy = dx / s - dot / (s * s) * centred / ((m - 1) * np.maximum(std, 1e-300))
        dy -= dy.mean(axis=(1, 2), keepdims=True)
        dy = dy[:, 1:]
        w = params[2 * k]
        grads[2 * k] = g.reshape(-1, w.shape[0]).T @ dy.reshape(-1, w.shape[1])
        grads[2 * k + 1] = dy.sum(axis=(0, 1))
        if k:
            dg = (dy @ w.T).reshape(b, n, 3, -1)
            dx = np.zeros(x_shape)
            np.add.at(dx, (np.broadcast_to(rows, idx.shape), idx), dg)
    return grads


class Adam:
    """Adam with its usual constants."""

    def __init__(self, params: list[np.ndarray], rate: float = 1e-3):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _epochs(n: int, epochs: int, size: int, seed: int) -> Callable:
    rng = np.random.default_rng(seed)
    return (order[i : i + size] for _ in range(epochs) for order in [rng.permutation(n)] for i in range(0, n, size))


def fit_pairs(trees: list[Tree], pairs: list[tuple[int, int, float]], epochs: int = 100, size: int = 64, seed: int = 0, params: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Binary cross-entropy of sigmoid(score a - score b) against label 1: a is no faster. Pairs are places in `trees`."""
    params = params if params is not None else init(trees[0].feat.shape[1], seed)
    adam, p = Adam(params), np.array(pairs, float).reshape(-1, 3)
    for some in _epochs(len(p), epochs, size, seed):
        a, b, y = p[some, 0].astype(int), p[some, 1].astype(int), p[some, 2]
        xa, xb = batch([trees[i] for i in a]), batch([trees[i] for i in b])
        sa, _, ca = forward(params, *xa)
        sb, _, cb = forward(params, *xb)
        d = (sigmoid(sa - sb) - y) / len(some)
        adam.step(params, [u + v for u, v in zip(backward(params, ca, d), backward(params, cb, -d))])
    return params


def fit_points(trees: list[Tree], target: np.ndarray, epochs: int = 100, size: int = 64, seed: int = 0, params: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Mean squared error of the score against a target: a normalised latency, or a rank score."""
    params = params if params is not None else init(trees[0].feat.shape[1], seed)
    adam = Adam(params)
    for some in _epochs(len(trees), epochs, size, seed):
        s, _, cache = forward(params, *batch([trees[i] for i in some]))
        adam.step(params, backward(params, cache, 2 * (s - target[some]) / len(some)))
    return params


def score(params: list[np.ndarray], trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and embeddings of the trees as one batch."""
    s, e, _ = forward(params, *batch(trees))
    return s, e


#: Weight of pairs whose labels differ by less than the bound, and that bound.
CLOSE_WEIGHT, CLOSE = 0.2, 0.1


def init_uncertain(n_features: int, seed: int = 0, widths: tuple[int, ...] = WIDTHS, hidden: int = DENSE[0]) -> list[np.ndarray]:
    """Convolutions, then a head on two embeddings side by side: probability that the first is no faster, and log variance."""
    conv = init(n_features, seed, widths)[: 2 * len(widths)]
    rng, out = np.random.default_rng(seed + 1), []
    for a, b in ((2 * widths[-1], hidden), (hidden, 2)):
        out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return conv + out


def _uncertain_forward(params: list[np.ndarray], first: list[Tree], second: list[Tree]) -> tuple[np.ndarray, np.ndarray, tuple]:
    n = len(params) - 4
    _, ea, ca = forward(params[:n], *batch(first), n_conv=n // 2)
    _, eb, cb = forward(params[:n], *batch(second), n_conv=n // 2)
    x = np.concatenate([ea, eb], axis=1)
    a = x @ params[n] + params[n + 1]
    h = np.where(a > 0, a, SLOPE * a)
    z = h @ params[n + 2] + params[n + 3]
    return sigmoid(z[:, 0]), z[:, 1], (ca, cb, x, a, h)


def uncertain(params: list[np.ndarray], first: list[Tree], second: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """For each two trees: probability that the first is no faster, and the variance of it."""
    p, log_var, _ = _uncertain_forward(params, first, second)
    return p, np.exp(log_var)


def uncertain_gradients(params: list[np.ndarray], first: list[Tree], second: list[Tree], t: np.ndarray, close: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean `uncertain_loss` of pairs of labels t whose latencies differ by `close`, and its gradients."""
    n = len(params) - 4
    p, log_var, (ca, cb, x, a, h) = _uncertain_forward(params, first, second)
    var = np.exp(log_var)
    weight = np.where(np.abs(close) < CLOSE, CLOSE_WEIGHT, 1.0) / len(t)
    dz = np.stack([-weight * (t - p) / var * p * (1 - p), weight * (0.5 - (t - p) ** 2 / (2 * var))], axis=1)
    da = (dz @ params[n + 2].T) * np.where(a > 0, 1.0, SLOPE)
    dx = da @ params[n].T
    half = dx.shape[1] // 2
    conv = [u + v for u, v in zip(backward(params[:n], ca, dx[:, :half], n // 2), backward(params[:n], cb, dx[:, half:], n // 2))]
    return float(uncertain_loss(p, t, var, close).mean()), conv + [x.T @ da, da.sum(0), h.T @ dz, dz.sum(0)]


def fit_uncertain(trees: list[Tree], pairs: list[tuple[int, int, float, float]], epochs: int = 100, size: int = 64, seed: int = 0, params: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Minimises `uncertain_loss` over pairs (a, b, label, difference of the latencies) of places in `trees`."""
    params = params if params is not None else init_uncertain(trees[0].feat.shape[1], seed)
    adam, p = Adam(params), np.array(pairs, float).reshape(-1, 4)
    for some in _epochs(len(p), epochs, size, seed):
        a, b = p[some, 0].astype(int), p[some, 1].astype(int)
        _, grads = uncertain_gradients(params, [trees[i] for i in a], [trees[i] for i in b], p[some, 2], p[some, 3])
        adam.step(params, grads)
    return params


def uncertain_loss(p: np.ndarray, t: np.ndarray, var: np.ndarray, close: np.ndarray, alpha: float = CLOSE_WEIGHT) -> np.ndarray:
    """Gaussian loss log(var) / 2 + (t - p) ** 2 / (2 var) of predictions with a variance; pairs of close labels weigh alpha."""
    return np.where(np.abs(close) < CLOSE, alpha, 1.0) * (0.5 * np.log(var) + (t - p) ** 2 / (2 * var))
