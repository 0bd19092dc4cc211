"""A bidirectional LSTM over sequences of feature sets, in numpy: forward pass, gradients, and Adam."""

from __future__ import annotations

import numpy as np

LABELS = ("text", "inline", "heading", "list", "code", "table", "formula", "syntax")
EMBED, HIDDEN = 20, 24


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def initial(buckets: int, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"E": r.normal(0, 0.3, (buckets, EMBED))}
    for d in "fb":
        p["W" + d] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        b = np.zeros(4 * HIDDEN)
        b[HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
        p["B" + d] = b
    p["V"] = r.normal(0, 0.25, (2 * HIDDEN + EMBED, len(LABELS)))
    p["C"] = np.zeros(len(LABELS))
    return p


def pack(sequences: list[list[tuple[int, ...]]]):
    """Flat feature ids, the leaf each belongs to, leaf -> (row, step), and a mask of rows x steps."""
    n, steps = len(sequences), max((len(s) for s in sequences), default=0)
    mask = np.zeros((n, steps), bool)
    ids, leaf, count = [], [], []
    k = 0
    for i, s in enumerate(sequences):
        mask[i, : len(s)] = True
        for f in s:
            ids.extend(f)
            leaf.extend([k] * len(f))
            count.append(max(len(f), 1))
            k += 1
    return np.array(ids, np.int64), np.array(leaf, np.int64), np.sqrt(np.array(count, float)), mask


def _embed(p, ids, leaf, scale, mask):
    flat = np.zeros((len(scale), EMBED), p["E"].dtype)
    if len(ids):
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        flat[leaf[starts]] = np.add.reduceat(p["E"][ids], starts, axis=0)
    flat /= scale[:, None]
    x = np.zeros((*mask.shape, EMBED), flat.dtype)
    x[mask] = flat
    return x


def _run(p, d, x, mask, keep: bool):
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out = np.zeros((n, steps, HIDDEN), x.dtype)
    past = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        m = mask[:, t, None]
        xh = np.concatenate([x[:, t], h], 1)
        z = xh @ p["W" + d] + p["B" + d]
        i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            past.append((t, xh, i, f, o, g, c, tc, m))
        c = np.where(m, c2, c)
        h = np.where(m, o * tc, h)
        out[:, t] = h
    return out, past


def scores(p, sequences) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every label for every leaf, in order, and the mask."""
    ids, leaf, scale, mask = pack(sequences)
    x = _embed(p, ids, leaf, scale, mask)
    f, _ = _run(p, "f", x, mask, False)
    b, _ = _run(p, "b", x, mask, False)
    return (np.concatenate([f, b, x], 2) @ p["V"] + p["C"])[mask], mask


CELLS = 1 << 17


def _groups(sequences, rows: int):
    """Sequences of like length, at most ``rows`` of them and about CELLS leaves with their padding; a longer one is alone."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    part: list[int] = []
    for i in order:
        if part and (len(part) == rows or (len(part) + 1) * len(sequences[i]) > CELLS):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def classify(p, sequences: list[list[tuple[int, ...]]], rows: int = 512) -> list[np.ndarray]:
    """The most likely label of every leaf of every sequence. Sequences of like length run together."""
    out: list = [np.zeros(0, np.int64)] * len(sequences)
    for group in _groups(sequences, rows):
        part = [i for i in group if sequences[i]]
        if part:
            best = scores(p, [sequences[i] for i in part])[0].argmax(1)
            at = 0
            for i in part:
                out[i] = best[at : at + len(sequences[i])]
                at += len(sequences[i])
    return out


def gradients(p, sequences, labels):
    """Mean cross entropy and its gradients."""
    ids, leaf, scale, mask = pack(sequences)
    x = _embed(p, ids, leaf, scale, mask)
    runs = {d: _run(p, d, x, mask, True) for d in "fb"}
    joined = np.concatenate([runs["f"][0], runs["b"][0], x], 2)
    z = joined[mask] @ p["V"] + p["C"]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    prob = e / e.sum(1, keepdims=True)
    n = len(labels)
    loss = -np.log(prob[np.arange(n), labels] + 1e-12).mean()
    prob[np.arange(n), labels] -= 1
    prob /= n
    g = {"V": joined[mask].T @ prob, "C": prob.sum(0)}
    back = np.zeros_like(joined)
    back[mask] = prob @ p["V"].T
    dx = back[:, :, 2 * HIDDEN :].copy()
    for k, d in enumerate("fb"):
        dout = back[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        dw, db = np.zeros_like(p["W" + d]), np.zeros_like(p["B" + d])
        dh = np.zeros((len(sequences), HIDDEN))
        dc = np.zeros_like(dh)
        for t, xh, i, f, o, gg, c, tc, m in reversed(runs[d][1]):
            dh = dh + dout[:, t]
            a = np.where(m, dh, 0)
            dco = np.where(m, dc, 0) + a * o * (1 - tc * tc)
            dz = np.concatenate([dco * gg * i * (1 - i), dco * c * f * (1 - f), a * tc * o * (1 - o), dco * i * (1 - gg * gg)], 1)
            dw += xh.T @ dz
            db += dz.sum(0)
            dxh = dz @ p["W" + d].T
            dx[:, t] += dxh[:, :EMBED]
            dh = np.where(m, dxh[:, EMBED:], dh)
            dc = np.where(m, dco * f, dc)
        g["W" + d], g["B" + d] = dw, db
    flat = dx[mask] / scale[:, None]
    de = np.zeros_like(p["E"])
    np.add.at(de, ids, flat[leaf])
    g["E"] = de
    return loss, g


class Adam:
    def __init__(self, p, rate=0.01):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.n, self.rate = 0, rate

    def step(self, p, g):
        self.n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k in p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k] * clip
            self.v[k] = 0.999 * self.v[k] + 0.001 * (g[k] * clip) ** 2
            p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)
