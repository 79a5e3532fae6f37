"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Inputs are symbol numbers of windows of one length.  Each direction has one table from symbols to gate
inputs and one recurrent matrix; both hidden states give emission scores, and a linear-chain CRF scores
label sequences with them.
"""

from __future__ import annotations

import numpy as np


def _gates(z: np.ndarray, h: int):
    """Input, forget and output gates and the candidate, from the gate inputs (changed in place)."""
    z[:, : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * h] *= 0.5
    z[:, : 3 * h] += 0.5
    return z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]


class Tagger:
    """Parameters: ``table`` and ``loop`` per direction, ``out`` and ``bias`` to labels, CRF ``move`` and ``start``."""

    names = ("table0", "loop0", "table1", "loop1", "out", "bias", "move", "start")

    def __init__(self, symbols: int, labels: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        self.hidden, self.labels = hidden, labels
        self.p = {}
        for d in "01":
            self.p["table" + d] = rng.normal(0, 0.3, (symbols, 4 * hidden)).astype(np.float32)
            self.p["table" + d][:, hidden : 2 * hidden] += 1.0  # remember at first
            self.p["loop" + d] = rng.normal(0, scale, (hidden, 4 * hidden)).astype(np.float32)
        self.p["out"] = rng.normal(0, scale, (2 * hidden, labels)).astype(np.float32)
        self.p["bias"] = np.zeros(labels, np.float32)
        self.p["move"] = np.zeros((labels, labels), np.float32)
        self.p["start"] = np.zeros(labels, np.float32)

    @classmethod
    def of(cls, hidden: int, params: dict) -> Tagger:
        new = object.__new__(cls)
        new.hidden, new.labels, new.p = hidden, len(params["bias"]), params
        return new

    # hidden states ---------------------------------------------------------------------------------

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (time, batch, hidden) of one direction over ``x`` (time, batch)."""
        steps, batch = x.shape
        h = self.hidden
        table, loop = self.p["table" + d], self.p["loop" + d]
        state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        states = np.empty((steps, batch, h), np.float32)
        kept = []
        for t in range(steps):
            z = table[x[t]]
            z += state @ loop
            i, f, o, g = _gates(z, h)
            before = cell
            cell = f * before + i * g
            squashed = np.tanh(cell)
            if keep:
                kept.append((state, before, squashed, z))
            state = o * squashed
            states[t] = state
        return states, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, batch, labels) of windows ``x`` (batch, time)."""
        x = np.ascontiguousarray(x.T)
        both = np.concatenate([self._run(x, "0", False)[0], self._run(x[::-1], "1", False)[0][::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best label sequences (batch, time) for emissions ``e``."""
        steps, batch, labels = e.shape
        score = self.p["start"] + e[0]
        back = np.empty((steps, batch, labels), np.int8)
        for t in range(1, steps):
            via = score[:, :, None] + self.p["move"]
            back[t] = via.argmax(axis=1)
            score = via.max(axis=1) + e[t]
        best = np.empty((batch, steps), np.int8)
        now = score.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            best[:, t] = now
            if t:
                now = back[t][np.arange(batch), now]
        return best

    # training --------------------------------------------------------------------------------------

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood per window and its gradients, for windows and labels (batch, time)."""
        batch, steps = x.shape
        xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        f_states, f_kept = self._run(xt, "0", True)
        b_states, b_kept = self._run(xt[::-1], "1", True)
        both = np.concatenate([f_states, b_states[::-1]], axis=2)
        e = both @ self.p["out"] + self.p["bias"]
        loss, de, dmove, dstart = self._crf(e, yt)
        de /= batch
        g = {"out": np.einsum("tbh,tbl->hl", both, de), "bias": de.sum((0, 1)), "move": dmove / batch, "start": dstart / batch}
        dboth = de @ self.p["out"].T
        h = self.hidden
        g["table0"], g["loop0"] = self._back(xt, "0", f_kept, dboth[:, :, :h])
        g["table1"], g["loop1"] = self._back(xt[::-1], "1", b_kept, dboth[::-1, :, h:])
        return loss / batch, g

    def _back(self, x, d, kept, dstates):
        h, loop = self.hidden, self.p["loop" + d]
        dloop, dgates = np.zeros_like(loop), np.empty((len(kept), len(x[0]), 4 * h), np.float32)
        dstate, dcell = np.zeros_like(dstates[0]), np.zeros_like(dstates[0])
        for t in range(len(kept) - 1, -1, -1):
            state, before, squashed, z = kept[t]
            i, f, o, c = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            ds = dstate + dstates[t]
            dc = dcell + ds * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - c * c)], axis=1)
            dgates[t] = dz
            dloop += state.T @ dz
            dstate = dz @ loop.T
            dcell = dc * f
        return _summed(dgates.reshape(-1, 4 * h), x.ravel(), len(self.p["table" + d])), dloop

    def _crf(self, e, y):
        """Summed loss and gradients by the forward-backward algorithm, every step's sums scaled to one."""
        steps, batch, labels = e.shape
        move, start = self.p["move"].astype(np.float64), self.p["start"].astype(np.float64)
        e64 = e.astype(np.float64)
        top = e64.max(axis=2, keepdims=True)
        weight, via = np.exp(e64 - top), np.exp(move)
        a, b, scale = np.empty_like(weight), np.ones_like(weight), np.empty((steps, batch, 1))
        for t in range(steps):
            a[t] = (a[t - 1] @ via if t else np.exp(start)) * weight[t]
            scale[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= scale[t]
        weight /= scale
        pairs = np.zeros_like(via)
        for t in range(steps - 2, -1, -1):
            ahead = weight[t + 1] * b[t + 1]
            pairs += a[t].T @ ahead  # small products, which start no threads
            b[t] = ahead @ via.T
        total = (np.log(scale) + top).sum((0, 2))
        marginal = a * b
        expected = pairs * via
        gold = np.zeros_like(marginal)
        np.put_along_axis(gold, y[:, :, None].astype(np.int64), 1.0, axis=2)
        seen = np.zeros((labels, labels))
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1.0)
        n = np.arange(batch)
        path = start[y[0]] + np.take_along_axis(e64, y[:, :, None].astype(np.int64), 2).sum((0, 2)) + move[y[:-1], y[1:]].sum(0)
        return float((total - path).sum()), (marginal - gold).astype(np.float32), expected - seen, marginal[0].sum(0) - np.bincount(y[0][n], minlength=labels)


def _summed(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by group."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    out = np.zeros((groups, rows.shape[1]), rows.dtype)
    out[group[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def fit(symbols: int, labels: int, x: np.ndarray, y: np.ndarray, allowed: np.ndarray | None = None, hidden: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Tagger:
    """A tagger trained on windows ``x`` with labels ``y``, by Adam steps on shuffled batches.

    Label pairs that are not ``allowed`` have a CRF transition so low that no path takes it.
    """
    tagger = Tagger(symbols, labels, hidden, seed)
    if allowed is not None:
        tagger.p["move"][~allowed] = -1e4
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step, steps = 0, epochs * max(1, -(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            k = order[lo : lo + batch]
            _, g = tagger.gradients(x[k], y[k])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for name, v in g.items():
                v = (v * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                m, s = first[name] / (1 - 0.9**step), second[name] / (1 - 0.99**step)
                tagger.p[name] -= (rate * (1 - 0.9 * step / steps) * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return tagger
