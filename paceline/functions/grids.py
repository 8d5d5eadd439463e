"""Grid kernels of the convolutional network, on numpy arrays (pure: no argument is changed)."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def correlate_valid(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Over the last two axes; the kernel is not flipped."""
    return np.einsum("...ijkl,kl->...ij", sliding_window_view(m, kernel.shape, axis=(-2, -1)), kernel)


def correlate_maps(axes: str, m: np.ndarray, kernels: np.ndarray, full: bool = False) -> np.ndarray:
    """Valid (or full) correlations of many grids with many kernels. ``axes`` names grids, kernels and result as
    einsum does; ij are the cells of the grids and of the result, kl those of the kernels."""
    h, w = kernels.shape[-2:]
    if full:
        m = np.pad(m, [(0, 0)] * (m.ndim - 2) + [(h - 1, h - 1), (w - 1, w - 1)])
    left, rest = axes.split(",")
    return np.einsum(f"{left}kl,{rest}", sliding_window_view(m, (h, w), axis=(-2, -1)), kernels, optimize=True)


def convolve_valid(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Over three axes, without flipping; batch and kernel must be equally deep."""
    if m.shape[0] != kernel.shape[0]:
        raise ValueError("grid and kernel must be equally deep")
    return sum(correlate_valid(a, k) for a, k in zip(m, kernel))


def matrix_sum(m: np.ndarray) -> float:
    return float(m.sum())


def batch_sum(m: np.ndarray, j: int) -> np.ndarray:
    """The sum over the batch of map j of (batch, maps, rows, columns)."""
    return m[:, j].sum(0)


def permutation_batch(size: int, batch: int, seed: int = 0) -> np.ndarray:
    """``batch`` distinct numbers below ``size`` in random order."""
    return np.random.default_rng(seed).permutation(size)[:batch]


def bits_to_int(values) -> int:
    """The number whose binary digits are 1 where a value is at least 0.500000001."""
    out = 0
    for v in values:
        out = 2 * out + int(v >= 0.500000001)
    return out


def correlate_full(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    a, b = kernel.shape[0] - 1, kernel.shape[1] - 1
    return correlate_valid(np.pad(m, [(0, 0)] * (m.ndim - 2) + [(a, a), (b, b)]), kernel)


def rot180(m: np.ndarray) -> np.ndarray:
    return m[..., ::-1, ::-1]


def mean_pool(m: np.ndarray, x: int, y: int) -> np.ndarray:
    h, w = m.shape[-2:]
    if h % x or w % y:
        raise ValueError("the scale must divide the grid")
    return m.reshape(*m.shape[:-2], h // x, x, w // y, y).mean(axis=(-3, -1))


def kronecker(m: np.ndarray, x: int, y: int) -> np.ndarray:
    """Each cell repeated x times y times."""
    return np.repeat(np.repeat(m, x, axis=-2), y, axis=-1)


def apply(m: np.ndarray, op) -> np.ndarray:
    """op of every element; the argument stays as it is."""
    return op(m)


def combine(a: np.ndarray, b: np.ndarray, op, first=None, second=None) -> np.ndarray:
    """op(first(a), second(b)) element by element."""
    return op(first(a) if first else a, second(b) if second else b)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-z))


def softmax_loss(out: np.ndarray, label: int) -> float:
    return float(-out[label] + np.log(np.exp(out - out.max()).sum()) + out.max())
