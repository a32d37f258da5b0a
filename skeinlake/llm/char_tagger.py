"""A bidirectional LSTM over characters with CRF transitions, in numpy: training on windows of one length, decoding of runs of any length."""

from __future__ import annotations

import numpy as np

#: ASCII punctuation that has a class of its own.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, UPPER, DIGIT, BLANK, OTHER, LETTER = range(6)
CLASSES = LETTER + 26 + len(PUNCTUATION)


def class_table() -> np.ndarray:
    """Class of each code point below 256: small letters and punctuation have their own; higher ones are OTHER."""
    out = np.full(256, OTHER, np.uint8)
    out[ord("a") : ord("z") + 1] = LETTER + np.arange(26)
    out[ord("A") : ord("Z") + 1] = UPPER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    for k, c in enumerate(PUNCTUATION):
        out[ord(c)] = LETTER + 26 + k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Parameters by name; windows are arrays (windows, length) of character classes, tags likewise.

    Both directions run side by side: their arrays have a leading axis of two, and the second one reads windows backwards.
    """

    def __init__(self, tags: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.hidden = hidden
        self.p = {"out": small(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "step": small(tags, tags), "first": np.zeros(tags, np.float32), "in": small(2, CLASSES, 4 * hidden), "rec": small(2, hidden, 4 * hidden)}
        self.p["in"][:, :, hidden : 2 * hidden] += 1  # forget gates begin open

    def _states(self, x: np.ndarray, saved: list | None = None) -> np.ndarray:
        """Hidden states (length, windows, 2 * hidden); `saved` takes what gradients need."""
        n, length = x.shape
        k, enter = self.hidden, self.p["in"]
        h = c = np.zeros((2, n, k), np.float32)
        out = np.empty((length, n, 2 * k), np.float32)
        for t in range(length):
            z = np.stack((enter[0][x[:, t]], enter[1][x[:, length - 1 - t]])) + h @ self.p["rec"]
            gates, a = _sigmoid(z[:, :, : 3 * k]), np.tanh(z[:, :, 3 * k :])
            before, old = c, h
            c = gates[:, :, k : 2 * k] * c + gates[:, :, :k] * a
            tc = np.tanh(c)
            h = gates[:, :, 2 * k :] * tc
            out[t, :, :k], out[length - 1 - t, :, k:] = h[0], h[1]
            if saved is not None:
                saved.append((old, before, gates, a, tc))
        return out

    def _chain(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward over scores (length, windows, tags): the probability of each tag at each place, that of each pair of tags summed over all places, and the logarithm of the sum over all taggings."""
        length = len(e)
        top = e.max(axis=2)
        w, step = np.exp(e - top[:, :, None]), np.exp(self.p["step"].astype(np.float64))
        alpha, beta, scale = np.empty_like(w), np.ones_like(w), np.empty_like(top)
        reach = w[0] * np.exp(self.p["first"])
        for t in range(length):
            if t:
                reach = (alpha[t - 1] @ step) * w[t]
            scale[t] = reach.sum(axis=1)
            alpha[t] = reach / scale[t][:, None]
        for t in range(length - 2, -1, -1):
            beta[t] = (w[t + 1] * beta[t + 1] / scale[t + 1][:, None]) @ step.T
        pairs = step * np.einsum("tni,tnj->ij", alpha[:-1], w[1:] * beta[1:] / scale[1:, :, None])
        return alpha * beta, pairs, np.log(scale).sum(axis=0) + top.sum(axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradients."""
        n, length = x.shape
        saved: list = []
        states = self._states(x, saved)
        e, step = (states @ self.p["out"] + self.p["bias"]).astype(np.float64), self.p["step"]
        tags, k = e.shape[2], self.hidden
        marginal, pairs, total = self._chain(e)
        at = y.T
        gold = self.p["first"][at[0]] + np.take_along_axis(e, at[:, :, None], 2)[:, :, 0].sum(axis=0) + step[at[:-1], at[1:]].sum(axis=0)
        gstep = pairs.copy()
        np.add.at(gstep, (at[:-1].ravel(), at[1:].ravel()), -1)
        de = marginal.copy()
        np.put_along_axis(de, at[:, :, None], np.take_along_axis(de, at[:, :, None], 2) - 1, 2)
        first = marginal[0].sum(axis=0) - np.bincount(at[0], minlength=tags)
        de = de.astype(np.float32)
        g = {"first": first, "step": gstep, "out": np.einsum("tnh,tny->hy", states, de), "bias": de.sum(axis=(0, 1))}
        back = de @ self.p["out"].T
        gin, grec = np.zeros_like(self.p["in"]), np.zeros_like(self.p["rec"])
        turned, each = self.p["rec"].transpose(0, 2, 1), np.arange(CLASSES)
        dh = dc = np.zeros((2, n, k), np.float32)
        for t in range(length - 1, -1, -1):
            old, before, gates, a, tc = saved[t]
            i, f, o = gates[:, :, :k], gates[:, :, k : 2 * k], gates[:, :, 2 * k :]
            dh = dh + np.stack((back[t, :, :k], back[length - 1 - t, :, k:]))
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * a * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)), axis=2)
            seen = np.stack((x[:, t], x[:, length - 1 - t]))[:, None, :] == each[None, :, None]
            gin += seen.astype(np.float32) @ dz
            grec += old.transpose(0, 2, 1) @ dz
            dh, dc = dz @ turned, dc * f
        g |= {"in": gin, "rec": grec}
        return float((total - gold).mean()), {name: (v / n).astype(np.float32) for name, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.015, seed: int = 11) -> float:
        """Trains with Adam for so many steps, or until nothing is left to learn; the order of windows depends on the seed alone.

        Returns the mean loss of the last steps.
        """
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        losses, order = [], np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            while len(order) < min(batch, len(x)):
                order = np.concatenate((order, rng.permutation(len(x))))
            some, order = order[:batch], order[batch:]
            loss, g = self.gradients(x[some], y[some])
            losses.append(loss)
            if step > 100 and np.mean(losses[-30:]) < 0.02:
                break
            for k, grad in g.items():
                grad = np.clip(grad, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                self.p[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return float(np.mean(losses[-30:]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of tags (windows, length, tags)."""
        return (self._states(x) @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def best(self, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best tags of runs of scores (places, tags), each decoded as one chain; all runs advance together."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        begin, length, step = offsets[:-1][order], lengths[order], self.p["step"].astype(np.float64)
        out, came = np.zeros(len(e), np.int8), np.zeros(e.shape, np.int8)
        if not len(order):
            return out
        active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
        value = e[begin].astype(np.float64) + self.p["first"]
        for t in range(1, len(active)):
            k, at = active[t], begin[: active[t]] + t
            reach = value[:k, :, None] + step
            came[at] = reach.argmax(axis=1)
            value[:k] = reach.max(axis=1) + e[at]
            value[:k] -= value[:k].max(axis=1)[:, None]
        state = value.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            k, at = active[t], begin[: active[t]] + t
            out[at] = state[:k]
            if t:
                state[:k] = came[at, state[:k]]
        return out

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """The probability of each tag at each place of windows of scores, under the whole chain of the window."""
        return self._chain(e.transpose(1, 0, 2).astype(np.float64))[0].transpose(1, 0, 2)
