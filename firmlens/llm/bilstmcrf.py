"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np

SYMBOLS = " \n\t@.-+()[]:/=\"'_%,;#"
_LETTERS = {c: i + 3 for i, c in enumerate(string.ascii_lowercase)}
_MARKS = {c: i + 3 + 26 + 1 for i, c in enumerate(SYMBOLS)}
#: Classes: 0 padding, 1 other, 2 digit, then letters without case, letters of other alphabets, marks.
N_CLASSES = 3 + 26 + 1 + len(SYMBOLS)
_table = np.ones(128, np.int64)
for _c, _i in {**_LETTERS, **_MARKS}.items():
    _table[ord(_c)] = _i
    _table[ord(_c.upper())] = _i
_table[48:58] = 2


def classes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(x < 128, _table[np.minimum(x, 127)], 29)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    kinds: tuple[str, ...]
    p: dict[str, np.ndarray]

    @property
    def n_tags(self) -> int:
        return 1 + 2 * len(self.kinds)

    def allowed(self) -> np.ndarray:
        """Transitions: I-k only after B-k or I-k."""
        ok = np.ones((self.n_tags, self.n_tags), bool)
        for k in range(len(self.kinds)):
            i = 2 + 2 * k
            ok[:, i] = False
            ok[i - 1, i] = ok[i, i] = True
        return ok

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: (T, B) classes. Returns (T, B, tags)."""
        hf, _ = _lstm(self.p["emb"][x], self.p["wx_f"], self.p["wh_f"], self.p["b_f"])
        hb, _ = _lstm(self.p["emb"][x[::-1]], self.p["wx_b"], self.p["wh_b"], self.p["b_b"])
        return np.concatenate([hf, hb[::-1]], 2) @ self.p["out"] + self.p["b_out"]

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed(), self.p["trans"], -1e4).astype(np.float32)


def new_model(kinds: tuple[str, ...], hidden: int = 16, emb: int = 12, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    n = 1 + 2 * len(kinds)
    w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"emb": w(N_CLASSES, emb) * 3, "out": w(2 * hidden, n), "b_out": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32)}
    for d in "fb":
        b = np.zeros(4 * hidden, np.float32)
        b[hidden : 2 * hidden] = 1
        p |= {f"wx_{d}": w(emb, 4 * hidden), f"wh_{d}": w(hidden, 4 * hidden), f"b_{d}": b}
    return Model(kinds, p)


def _lstm(x, wx, wh, b):
    """x: (T, B, E). Gates in the order in, forget, out, candidate. Returns h (T, B, H) and what the way back needs."""
    T, B, _ = x.shape
    H = wh.shape[0]
    pre = x @ wx + b
    h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    hs, keep = np.empty((T, B, H), np.float32), []
    for t in range(T):
        z = pre[t] + h @ wh
        g = _sigmoid(z[:, : 3 * H])
        i, f, o, u = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :], np.tanh(z[:, 3 * H :])
        before, h0 = c, h
        c = f * c + i * u
        th = np.tanh(c)
        h = o * th
        hs[t] = h
        keep.append((i, f, o, u, before, th, h0))
    return hs, (x, wx, wh, keep)


def _lstm_back(dh, saved):
    x, wx, wh, keep = saved
    T, B, H = dh.shape
    dz = np.empty((T, B, 4 * H), np.float32)
    dwh = np.zeros_like(wh)
    nh, nc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    for t in range(T - 1, -1, -1):
        i, f, o, u, before, th, h0 = keep[t]
        d = dh[t] + nh
        dc = nc + d * o * (1 - th * th)
        dz[t] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), d * th * o * (1 - o), dc * i * (1 - u * u)], 1)
        nh, nc = dz[t] @ wh.T, dc * f
        dwh += h0.T @ dz[t]
    flat = dz.reshape(-1, 4 * H)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(e, tags, trans):
    """e: (T, B, K); tags: (T, B). Returns the mean loss, and its gradients by e and trans."""
    T, B, K = e.shape
    a = np.empty_like(e)
    b = np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, T):
        a[t] = _lse(a[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(T - 2, -1, -1):
        b[t] = _lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    dt = np.zeros_like(trans)
    for t in range(1, T):
        dt += np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
    rows = np.arange(B)
    score = e[0, rows, tags[0]].copy()
    for t in range(1, T):
        score += e[t, rows, tags[t]] + trans[tags[t - 1], tags[t]]
        np.add.at(dt, (tags[t - 1], tags[t]), -1)
    np.add.at(de, (np.arange(T)[:, None], rows[None, :], tags), -1)
    return float((z - score).mean()), (de / B).astype(np.float32), (dt / B).astype(np.float32)


def train(model: Model, x: np.ndarray, tags: np.ndarray, steps: int = 200, batch: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
    """x, tags: (N, T). Adam over random batches; changes the model and returns the losses."""
    rng = np.random.default_rng(seed)
    m, v, losses = {k: np.zeros_like(w) for k, w in model.p.items()}, {k: np.zeros_like(w) for k, w in model.p.items()}, []
    p = model.p
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        xs, ys = x[pick].T, tags[pick].T
        hf, sf = _lstm(p["emb"][xs], p["wx_f"], p["wh_f"], p["b_f"])
        hb, sb = _lstm(p["emb"][xs[::-1]], p["wx_b"], p["wh_b"], p["b_b"])
        h = np.concatenate([hf, hb[::-1]], 2)
        loss, de, dt = crf_loss(h @ p["out"] + p["b_out"], ys, model.transitions())
        losses.append(loss)
        g = {"trans": np.where(model.allowed(), dt, 0), "b_out": de.sum((0, 1)), "out": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, de.shape[2]), "emb": np.zeros_like(p["emb"])}
        dh, H = de @ p["out"].T, hf.shape[2]
        for d, grad, saved, xx in (("f", dh[:, :, :H], sf, xs), ("b", dh[::-1, :, H:], sb, xs[::-1])):
            dx, g[f"wx_{d}"], g[f"wh_{d}"], g[f"b_{d}"] = _lstm_back(grad, saved)
            np.add.at(g["emb"], xx.ravel(), dx.reshape(-1, dx.shape[2]))
        size = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, w in g.items():
            w = w * min(1, 5 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * w
            v[k] = 0.99 * v[k] + 0.01 * w * w
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return losses


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """e: (T, B, K), sequences of the given lengths. Returns (T, B) tags."""
    T, B, K = e.shape
    start = np.zeros(K, np.float32)
    start[2::2] = -1e4
    s = e[0] + start
    back = np.zeros((T, B, K), np.int8)
    for t in range(1, T):
        x = s[:, :, None] + trans
        back[t] = x.argmax(1)
        live = (t < lengths)[:, None]
        s = np.where(live, x.max(1) + e[t], s)
    out = np.zeros((T, B), np.int8)
    at = s.argmax(1)
    rows = np.arange(B)
    for t in range(T - 1, -1, -1):
        live = t < lengths
        out[t] = np.where(live, at, 0)
        if t:
            at = np.where(live, back[t, rows, at], at)
    return out
