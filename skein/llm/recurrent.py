"""A bidirectional LSTM that labels every element of a sequence, in numpy: forward, backward, Adam."""

from __future__ import annotations

import numpy as np

#: Units of a direction; steps of the fit, sequences of a step; Adam's rate.
UNITS, ROUNDS, AT_ONCE, RATE = 16, 8, 16, 0.01


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """Hidden states (rows, steps, units) in ``order`` of steps; where ``mask`` is 0 a state stays as it is."""
    n, steps, units = len(x), x.shape[1], len(u)
    before = x @ w + b
    h = c = np.zeros((n, units), x.dtype)
    out = np.zeros((n, steps, units), x.dtype)
    for t in order:
        z = before[:, t] + h @ u
        gates = _sigmoid(z[:, : 3 * units])
        i, f, o, g = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :], np.tanh(z[:, 3 * units :])
        m = mask[:, t, None]
        cell = f * c + i * g
        squashed = np.tanh(cell)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, squashed, m))
        h, c = m * (o * squashed) + (1 - m) * h, m * cell + (1 - m) * c
        out[:, t] = h
    return out


def _run_back(x: np.ndarray, u: np.ndarray, w: np.ndarray, kept: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of w, u and b, given those of the hidden states."""
    units = len(u)
    dz_all = np.zeros((len(x), x.shape[1], 4 * units), x.dtype)
    du = np.zeros_like(u)
    dh = dc = np.zeros((len(x), units), x.dtype)
    for t, h, c, i, f, o, g, squashed, m in reversed(kept):
        dh = dh + slope[:, t]
        new_h, new_c = m * dh, m * dc
        cell = new_c + new_h * o * (1 - squashed**2)
        dz = np.concatenate((cell * g * i * (1 - i), cell * c * f * (1 - f), new_h * squashed * o * (1 - o), cell * i * (1 - g**2)), 1)
        dz_all[:, t] = dz
        du += h.T @ dz
        dh, dc = (1 - m) * dh + dz @ u.T, (1 - m) * dc + cell * f
    flat = dz_all.reshape(-1, 4 * units)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def padded(rows: list[np.ndarray], dtype=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side, and a mask of their elements."""
    x = np.zeros((len(rows), max(map(len, rows)), rows[0].shape[1]), dtype)
    mask = np.zeros(x.shape[:2], dtype)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


class Labeller:
    """``weights``: of the forward and the backward direction (w, u, b each), and of the outputs."""

    def __init__(self, size: int, units: int = UNITS, seed: int = 0, dtype=np.float32):
        rng = np.random.default_rng(seed)
        made = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)
        bias = np.zeros(4 * units, dtype)
        bias[units : 2 * units] = 1  # remember at first
        self.weights = [made(size, 4 * units), made(units, 4 * units), bias, made(size, 4 * units), made(units, 4 * units), bias.copy(), made(2 * units), np.zeros(size, dtype), np.zeros(1, dtype)]

    def margins(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The labels' log odds (rows, steps), and the hidden states."""
        fw, fu, fb, bw, bu, bb, out, direct, shift = self.weights
        steps = x.shape[1]
        ahead = _run(x, mask, fw, fu, fb, range(steps), keep and keep[0])
        back = _run(x, mask, bw, bu, bb, range(steps - 1, -1, -1), keep and keep[1])
        hidden = np.concatenate((ahead, back), 2)
        return hidden @ out + x @ direct + shift[0], hidden

    def slopes(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean log loss over the elements, and its slope by each weight."""
        fw, fu, _, bw, bu, _, out, _, _ = self.weights
        keep: tuple[list, list] = ([], [])
        margin, hidden = self.margins(x, mask, keep)
        total = mask.sum()
        loss = float((mask * (np.logaddexp(0, margin) - labels * margin)).sum() / total)
        d = mask * (_sigmoid(margin) - labels) / total
        units = len(fu)
        ahead = _run_back(x, fu, fw, keep[0], d[:, :, None] * out[:units])
        back = _run_back(x, bu, bw, keep[1], d[:, :, None] * out[units:])
        return loss, [*ahead, *back, np.einsum("nt,ntu->u", d, hidden), np.einsum("nt,ntd->d", d, x), d.sum(keepdims=True)[0]]

    def fit(self, rows: list[np.ndarray], labels: list[np.ndarray], rounds: int = ROUNDS, seed: int = 0) -> None:
        """Adam over shuffled groups of sequences of like length; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        groups = np.array_split(np.argsort([len(r) for r in rows], kind="stable"), max(1, len(rows) // AT_ONCE))
        for k in range(rounds):
            for g in rng.permutation(len(groups)):
                x, mask = padded([rows[i] for i in groups[g]])
                y, _ = padded([labels[i][:, None] for i in groups[g]])
                _, slopes = self.slopes(x, mask, y[:, :, 0])
                size = np.sqrt(sum(float((s * s).sum()) for s in slopes))
                step += 1
                rate = RATE * (1 - 0.9 * k / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for w, s, m, v in zip(self.weights, slopes, first, second, strict=True):
                    s = s / max(1.0, size)
                    m += 0.1 * (s - m)
                    v += 0.001 * (s * s - v)
                    w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(w.dtype)
