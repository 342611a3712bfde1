"""A small character convolutional network in numpy: embedding, convolution, max pooling, logistic output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters that the network tells apart; every byte beyond ASCII is one of them.
SYMBOLS = 130
PAD = 129


def encode(windows: list[bytes], width: int) -> np.ndarray:
    """Windows as a matrix of symbols, padded to ``width``."""
    out = np.full((len(windows), width), PAD, np.int64)
    for row, w in zip(out, windows, strict=True):
        row[: len(w)] = np.minimum(np.frombuffer(w[:width], np.uint8), 128)
    return out


@dataclass
class CharCNN:
    """``emb`` symbols x dims, ``conv`` (reach * dims) x filters, ``out`` filters; two constants; a calibration."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    const: np.ndarray
    reach: int
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def start(cls, dims: int = 8, filters: int = 24, reach: int = 5, seed: int = 7) -> CharCNN:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (SYMBOLS, dims)), rng.normal(0, 0.3, (reach * dims, filters)), np.zeros(filters), rng.normal(0, 0.3, filters), np.zeros(1), reach)

    def _forward(self, x: np.ndarray):
        e = self.emb[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.reach, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.conv.shape[0])
        a = cols @ self.conv + self.bias
        at = a.argmax(1)
        top = np.take_along_axis(a, at[:, None], 1)[:, 0]
        h = np.maximum(top, 0)
        return cols, at, top, h, h @ self.out + self.const[0]

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + batch])[-1] for i in range(0, len(x), batch)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that each window holds a secret."""
        return self.calibrated(self.logits(x))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the class-balanced logistic loss."""
        params = [self.emb, self.conv, self.bias, self.out, self.const]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, t = np.random.default_rng(seed), 0
        weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                k = order[i : i + batch]
                cols, at, top, h, z = self._forward(x[k])
                dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[k]) * weigh[k] / len(k)
                dh = dz[:, None] * self.out * (top > 0)
                picked = cols[np.arange(len(k))[:, None], at]  # windows x filters x (reach * dims)
                grads = [np.zeros_like(self.emb), np.einsum("nfc,nf->cf", picked, dh), dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]
                de = np.einsum("nf,cf->nfc", dh, self.conv).reshape(len(k), dh.shape[1], self.reach, -1)
                where = x[k][np.arange(len(k))[:, None, None], at[:, :, None] + np.arange(self.reach)]
                np.add.at(grads[0], where.ravel(), de.reshape(-1, de.shape[-1]))
                t += 1
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 400) -> None:
        """Platt scaling on rows that the network was not fitted on."""
        self.calibrate_counts(self.logits(x), y, np.ones(len(y)), rounds)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, many: np.ndarray, rounds: int = 400) -> None:
        """Platt scaling on logits with their labels, each as often as ``many`` says."""
        hits, rows = (many * y).sum(), many.sum()
        target = np.where(y == 1, (hits + 1) / (hits + 2), 1 / (rows - hits + 2))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))
            self.scale -= 0.1 * float(((p - target) * z * many).sum() / rows)
            self.shift -= 0.1 * float(((p - target) * many).sum() / rows)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """The probabilities that logits stand for."""
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))

    def parameters(self) -> np.ndarray:
        """All that is fitted but the calibration, in one row."""
        return np.concatenate([p.ravel() for p in (self.emb, self.conv, self.bias, self.out, self.const)])

    def with_parameters(self, flat: np.ndarray) -> CharCNN:
        """A network of this shape with these :meth:`parameters`."""
        parts, at = [], 0
        for p in (self.emb, self.conv, self.bias, self.out, self.const):
            parts.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return CharCNN(*parts, self.reach)


def recall_threshold(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The highest threshold at which at least ``recall`` of the positives are found."""
    hits = np.sort(p[y == 1])
    return float(hits[int(np.floor((1 - recall) * len(hits)))])
