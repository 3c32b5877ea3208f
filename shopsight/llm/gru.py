"""A gated recurrent language model with a class-factored softmax, in numpy.

The vocabulary is cut into classes of equal size by frequency, so a token costs one softmax over classes and
one over its class. Training is truncated backpropagation over windows: the documents stand one after the other
in random order, and the row is cut into lanes of equal length that are trained in step. The state is carried
from window to window, in training and in scoring, and reset at the beginning of a document (in training also
where a lane begins inside one; the token before it is known there).

Weights and states of the three gates (update, reset, new state) lie apart, each contiguous.
"""

from __future__ import annotations

import heapq

import numpy as np

PIECE = 4096  # tokens of a document that count for a lane of their own


def _sigmoid(x):
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(np.float32(1), x, out=x)


def _softmax(x, at, reach):
    """Exponentials (in place), their sums and the log probabilities of the places ``at`` (into the flat array); only
    where a score could be large (``reach``) is the largest taken off."""
    if reach > 60:
        x -= x.max(axis=1, keepdims=True)
    found = x.reshape(-1)[at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    found -= np.log(total)
    return total, found


class Gru:
    def __init__(self, vocabulary: int, hidden: int = 24, seed: int = 9):
        self.vocabulary, self.hidden = vocabulary, hidden
        self.width = max(1, int(np.ceil(vocabulary ** 0.5)))  # words of a class
        classes = -(-vocabulary // self.width)
        random = np.random.default_rng(seed)
        draw = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        gates = lambda rows: np.ascontiguousarray(draw(rows, 3 * hidden).reshape(rows, 3, hidden).transpose(1, 0, 2))
        self.w = {
            "x": gates(vocabulary + 1),  # the last row stands for the beginning of a document
            "u": gates(hidden), "b": np.zeros(hidden, np.float32),
            "c": draw(hidden, classes), "cb": np.zeros(classes, np.float32),
            "o": draw(classes, hidden, self.width), "ob": np.zeros((classes, self.width), np.float32),
        }
        spare = classes * self.width - vocabulary  # places of the last class that no word has
        if spare:
            self.w["ob"][-1, self.width - spare:] = -1e4

    def read(self, tokens: np.ndarray) -> np.ndarray:
        """What the tokens add to the gates: (3, tokens, hidden)."""
        return np.stack([np.take(x, tokens, axis=0, mode="clip") for x in self.w["x"]])

    def step(self, h, x, a=None):
        """The next state. ``x`` (by gate) becomes z, r and the new state, ``a`` takes what the old state adds."""
        a = np.matmul(h, self.w["u"], out=a)
        gates, inner, new = x[:2], a[2], x[2]
        gates += a[:2]
        _sigmoid(gates)
        inner += self.w["b"]
        new += gates[1] * inner
        np.tanh(new, out=new)
        out = h - new
        out *= gates[0]
        out += new
        return out

    def run(self, h, tokens, carry):
        """Steps over rows of tokens read by the lanes; a state is kept where ``carry`` is 1. Gates, what old states added, and states before and after."""
        shape = (*tokens.shape, self.hidden)
        gates = self.read(tokens.reshape(-1)).reshape(3, *shape)
        added, before, states = np.empty_like(gates), np.empty(shape, np.float32), np.empty(shape, np.float32)
        for k in range(len(tokens)):
            np.multiply(h, carry[k], out=before[k])
            h = states[k] = self.step(before[k], gates[:, k], added[:, k])
        return gates, added, before, states

    def log_probs(self, h, target, grads=None):
        """Natural log probabilities of the targets; with ``grads`` also adds gradients and gives those of h."""
        w, n = self.w, self.hidden
        group = (target // self.width).astype(np.int16)
        order = np.argsort(group, kind="stable")
        group, target = group[order].astype(np.int64), target[order]
        rows = np.arange(len(order))
        own = np.ones((len(order), n + 1), np.float32)  # the ones meet the biases
        own[:, :n] = h.take(order, axis=0)
        cuts = np.searchsorted(group, np.arange(len(w["cb"]) + 1)).tolist()
        parts = [(k, slice(*cuts[k:k + 2])) for k in np.unique(group).tolist()]
        used = [k for k, _ in parts]
        # the state lies in -1 to 1, so no score is further from 0 than this
        reach = np.abs(w["ob"][used]).max(where=w["ob"][used] > -1e3, initial=0) + np.abs(w["o"][used]).sum(axis=1).max(initial=0)
        e = own @ np.concatenate([w["c"], w["cb"][None]])
        at_group = rows * e.shape[1] + group
        total, found = _softmax(e, at_group, np.abs(w["cb"]).max() + np.abs(w["c"]).sum(axis=0).max())
        words = np.concatenate([w["o"], w["ob"][:, None]], axis=1)
        x = np.empty((len(order), self.width), np.float32)
        for k, part in parts:
            np.matmul(own[part], words[k], out=x[part])
        at_word = rows * self.width + target - group * self.width
        total_words, more = _softmax(x, at_word, reach)
        out = np.empty(len(order))
        out[order] = found.astype(np.float64) + more
        if grads is None:
            return out
        for some, at, sums in ((e, at_group, total), (x, at_word, total_words)):
            some /= sums[:, None]
            some.reshape(-1)[at] -= 1
        slope = own.T @ e
        grads["c"] += slope[:n]
        grads["cb"] += slope[n]
        back = np.empty((len(order), n), np.float32)
        for k, part in parts:
            slope = own[part].T @ x[part]
            grads["o"][k] += slope[:n]
            grads["ob"][k] += slope[n]
            np.matmul(x[part], w["o"][k].T, out=back[part])
        back += e @ w["c"].T
        inverse = np.empty_like(order)
        inverse[order] = rows
        return out, back.take(inverse, axis=0)

    def begin(self, counts: np.ndarray) -> None:
        """Start at the frequencies of classes and of their words; ``counts`` has one number per word."""
        counts = np.concatenate([counts, np.zeros(self.w["ob"].size - len(counts))]).reshape(self.w["ob"].shape) + 0.1
        self.w["cb"] = np.log(counts.sum(axis=1) / counts.sum()).astype(np.float32)
        self.w["ob"] = np.where(self.w["ob"] < -1e3, self.w["ob"], np.log(counts / counts.sum(axis=1, keepdims=True))).astype(np.float32)

    def fit(self, docs: list[np.ndarray], *, lanes: int = 96, window: int = 20, epochs: int = 2, least_steps: int = 250, rate: float = 0.01,
            seed: int = 4, part: tuple[int, int] | None = None) -> Gru:
        """Passes over the documents. ``part`` = (k, n) is the k-th of n stretches of one longer fit, which :meth:`begin` has begun."""
        random = np.random.default_rng(seed)
        docs = [d for d in docs if len(d)]
        if not docs:
            return self
        if part is None:
            self.begin(np.bincount(np.concatenate(docs), minlength=self.vocabulary))
        done, stretches = part or (0, 1)
        total, n, steps = sum(map(len, docs)), self.hidden, 0
        lanes = min(lanes, sum(-(-len(d) // PIECE) for d in docs))
        length = -(-total // lanes)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        per_epoch = -(-length // window)
        epochs = max(epochs, -(-least_steps // per_epoch))
        for _ in range(epochs):
            order = [docs[i] for i in random.permutation(len(docs))]
            flat = np.concatenate([*order, np.full(lanes * length - total, -1)]).astype(np.int32)
            begins = np.zeros(len(flat), bool)
            begins[np.cumsum([0, *map(len, order)])[:-1]] = True
            read = np.where(begins, self.vocabulary, np.roll(flat, 1))
            begins[::length] = True
            target, source, carried = (np.ascontiguousarray(x.reshape(lanes, length).T) for x in (flat, read, ~begins))
            carried = carried[:, :, None].astype(np.float32)
            h = np.zeros((lanes, n), np.float32)
            for begin in range(0, length, window):
                t, s, carry = (x[begin:begin + window] for x in (target, source, carried))
                gates, added, before, states = self.run(h, s, carry)
                h, s = states[-1], s.reshape(-1)
                flat_states, real = states.reshape(-1, n), np.flatnonzero(t.reshape(-1) >= 0)
                count = len(real)
                if not count:
                    continue
                grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                if count == len(s):
                    _, slope = self.log_probs(flat_states, t.reshape(-1), grads)
                else:
                    slope = np.zeros_like(flat_states)
                    slope[real] = self.log_probs(flat_states[real], t.reshape(-1)[real], grads)[1]
                slope = slope.reshape(states.shape)
                (z, r, new), inner = gates, added[2]
                slope_n = (1 - z) * (1 - new * new)
                slope_z = (before - new) * (z - z * z)
                slope_r = inner * (r - r * r)
                turned = np.ascontiguousarray(self.w["u"].transpose(0, 2, 1))
                dh = np.zeros((lanes, n), np.float32)
                rows = added  # by gate: slopes of what the old state added
                for k in range(len(t) - 1, -1, -1):
                    dh += slope[k]
                    dn, (dz, dr, da) = new[k], rows[:, k]
                    np.multiply(dh, slope_n[k], out=dn)
                    np.multiply(dh, slope_z[k], out=dz)
                    np.multiply(dn, slope_r[k], out=dr)
                    np.multiply(dn, r[k], out=da)
                    dh *= z[k]
                    for part_of in np.matmul(rows[:, k], turned):
                        dh += part_of
                    dh *= carry[k]
                rows = rows.reshape(3, -1, n)
                grads["u"] += np.matmul(before.reshape(-1, n).T, rows)
                grads["b"] += np.ones(rows.shape[1], np.float32) @ rows[2]
                order = np.argsort(s.astype(np.uint16) if self.vocabulary < 1 << 16 else s, kind="stable")
                words = s[order]
                cuts = np.flatnonzero(np.diff(words.astype(np.int32), prepend=-1))
                for own, slopes in zip(grads["x"], (rows[0], rows[1], new.reshape(-1, n))):
                    own[words[cuts]] = np.add.reduceat(slopes.take(order, axis=0), cuts)
                steps += 1
                pace = rate * 0.5 * (1 + np.cos(np.pi * (done + min(1, steps / (epochs * per_epoch))) / stretches)) + 1e-4
                if done:
                    pace *= min(1, steps / 10)  # the moments begin anew
                for k, g in grads.items():
                    g *= np.float32(1 / count)
                    np.clip(g, -0.1, 0.1, out=g)
                    one, two = first[k], second[k]
                    one *= np.float32(0.9)
                    one += np.float32(0.1) * g
                    g *= g
                    g *= np.float32(0.002)
                    two *= np.float32(0.998)
                    two += g
                    np.multiply(two, np.float32(1 / (1 - 0.998 ** steps)), out=g)
                    np.sqrt(g, out=g)
                    g += np.float32(1e-8)
                    np.divide(one, g, out=g)
                    g *= np.float32(pace / (1 - 0.9 ** steps))
                    self.w[k] -= g
        return self

    def vector(self) -> np.ndarray:
        """All weights as one vector."""
        return np.concatenate([v.reshape(-1) for v in self.w.values()])

    def put(self, vector: np.ndarray) -> None:
        """Take the weights from a vector; places without a word stay out of reach."""
        at, none = 0, self.w["ob"] < -1e3
        for k, v in self.w.items():
            self.w[k] = vector[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        self.w["ob"][none] = -1e4

    def score(self, flat: np.ndarray, lengths: np.ndarray, *, lanes: int = 512, window: int = 32) -> np.ndarray:
        """Natural log probability of each document; documents stand one after the other in ``flat``.

        Whole documents are dealt to lanes, the longest first and each to the shortest lane.
        """
        out, begins = np.zeros(len(lengths)), np.cumsum(lengths) - lengths
        docs = np.argsort(-lengths, kind="stable")
        docs = docs[:np.count_nonzero(lengths)]
        if not len(docs):
            return out
        lanes = min(lanes, len(docs))
        loads, lane = [(0, k) for k in range(lanes)], []
        for n in lengths[docs].tolist():
            load, k = loads[0]
            heapq.heapreplace(loads, (load + n, k))
            lane.append(k)
        n = np.array([load for load, _ in sorted(loads, key=lambda x: x[1])])
        rank = np.empty(lanes, np.int64)  # full lanes stand first, so those that still run do
        rank[np.argsort(-n, kind="stable")] = np.arange(lanes)
        n = -np.sort(-n)
        docs = docs[np.argsort(rank[lane], kind="stable")]
        ends = np.cumsum(lengths[docs])
        starts = ends - lengths[docs]
        owner = np.repeat(docs, lengths[docs])
        target = flat[np.arange(len(owner)) + np.repeat(begins[docs] - starts, lengths[docs])]
        source = np.roll(target, 1)
        source[starts] = self.vocabulary
        carried = np.ones((len(owner), 1), np.float32)
        carried[starts] = 0
        first, h = np.cumsum(n) - n, np.zeros((lanes, self.hidden), np.float32)
        for t in range(0, int(n[0]), window):
            live = int(np.searchsorted(-n, -t, "left"))
            step = np.arange(t, min(t + window, int(n[0])))[:, None]
            at = first[:live] + np.minimum(step, n[:live] - 1)
            states = self.run(h[:live], source[at], carried[at])[3]
            h, at, states = states[-1], at.reshape(-1), states.reshape(-1, self.hidden)
            real = np.flatnonzero((step < n[:live]).reshape(-1))
            if len(real) < len(at):
                at, states = at[real], states[real]
            log = self.log_probs(states, target[at])
            out += np.bincount(owner[at], log, len(out))
        return out
