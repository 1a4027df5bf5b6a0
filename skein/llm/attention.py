"""A causal self-attention model over subword ids, trained and applied in numpy.

A unit's query, key, value and own vector are a row of one table: the `own_rows` most frequent units
have rows of their own, others share their class's. Attention has one head with a learnt bias for
each distance; the state of a position is what it attends to plus its own vector.

The output is a softmax over all units in two learnt levels: classes by falling frequency, the first
`HEAD` of one unit each, then the units of a class. Both depend on the state, so a unit's probability
is p(class | state) * p(unit | class, state), and the units' probabilities sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WIDTH, STEP = 16, 16
#: Units that a window holds; the second half of a window that is scored has STEP units before it at least.
LENGTH = 2 * STEP
HEAD, OWN_ROWS = 96, 1024
#: Classes after the head: how many, of how many units; the last size goes on to the end.
BANDS = ((8, 32), (8, 64), (8, 128), (None, 2048))
#: Windows that a training step takes.
BATCH = 128
#: Rows whose classes a training step computes at once, and the largest classes that it takes side by side.
ROWS, GROUPED = 1024, 256
#: Cells of a product that scoring makes at once for units of a class.
LEAF_CELLS = 1 << 18
GAP = np.arange(LENGTH)[:, None] - np.arange(LENGTH)[None, :]
_NEVER = np.float32(-1e9)


@dataclass(frozen=True)
class Layout:
    """starts: bounds of the classes in order of rank; rank, cls and row by unit."""

    starts: np.ndarray
    rank: np.ndarray
    cls: np.ndarray
    row: np.ndarray
    rows: int

    @staticmethod
    def of(counts: np.ndarray, own_rows: int = OWN_ROWS) -> Layout:
        m = len(counts)
        rank = np.empty(m, np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(m)
        starts = list(range(min(HEAD, m)))
        at = len(starts)
        for many, size in BANDS:
            while at < m and many != 0:
                starts.append(at)
                at += size
                many = None if many is None else many - 1
        starts = np.array([*starts, m])
        cls = (np.searchsorted(starts, rank, side="right") - 1).astype(np.uint16)
        row = np.where(rank < own_rows, rank, own_rows + cls).astype(np.int32)
        return Layout(starts, rank, cls, row, own_rows + len(starts) - 1)


def _row_sums(z: np.ndarray) -> np.ndarray:
    """Sums over the last axis, by a product: short rows are slow to add up one by one."""
    return (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], z.dtype)).reshape(z.shape[:-1])


def _softmax_parts(z: np.ndarray, again) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of z, in its place, and their sums, unshifted where that doesn't overflow; again() gives z anew."""
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=z)
        sums = _row_sums(z)
    if not (np.isfinite(sums).all() and sums.all()):
        z = again()
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        sums = z.sum(1)
    return z, sums


class Attention:
    """weights: rows (rows, 4 * WIDTH), bias by distance, out (WIDTH + 1, classes), leaves (units by rank, WIDTH + 1)."""

    def __init__(self, layout: Layout, weights: list[np.ndarray]):
        self.layout, self.weights = layout, weights

    @staticmethod
    def start(layout: Layout, counts: np.ndarray, seed: int = 1) -> Attention:
        """Small random rows; the outputs give each unit its share of the counts."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        total = np.bincount(layout.cls, weights=counts, minlength=len(layout.starts) - 1)
        out = np.concatenate([small(WIDTH, len(total)), np.log(total / total.sum())[None]]).astype(np.float32)
        leaves = np.zeros((len(counts), WIDTH + 1), np.float32)
        leaves[layout.rank, WIDTH] = np.log(counts / total[layout.cls])
        return Attention(layout, [small(layout.rows, 4 * WIDTH), np.zeros(LENGTH, np.float32), out, leaves])

    def copy(self) -> Attention:
        return Attention(self.layout, [w.copy() for w in self.weights])

    def states(self, x: np.ndarray, first: int = 0, ok: np.ndarray | None = None, shares: bool = True) -> tuple:
        """States from position `first` on, with a one beside each, and what the gradient needs.

        x: rows (windows, LENGTH); ok: positions that are of the text, all where it is None; shares:
        whether the last, what each position attends to, has to sum to one.
        """
        table, bias = self.weights[:2]
        g = table[x]
        q, k, v, own = (g[..., i * WIDTH : (i + 1) * WIDTH] for i in range(4))
        gap = GAP[first:]
        rel = np.where(gap >= 0, bias[np.maximum(gap, 0)], _NEVER)
        part = np.flatnonzero(~ok.all(1)) if ok is not None else []

        def scores() -> np.ndarray:
            s = np.matmul(q[:, first:] * np.float32(1 / math.sqrt(WIDTH)), k.transpose(0, 2, 1))
            s += rel
            if len(part):
                s[part] += np.where(ok[part], np.float32(0), _NEVER)[:, None, :]
            return s

        s = scores()
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(s, out=s)
            sums = _row_sums(s)[..., None]
        if not (np.isfinite(sums).all() and sums.all()):  # an overflow, or positions outside the text, which nobody reads
            s = scores()
            s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            sums = s.sum(-1, keepdims=True)
        n, length = x.shape[0], x.shape[1] - first
        state = np.ones((n * length, WIDTH + 1), np.float32)
        h = state[:, :WIDTH].reshape(n, length, WIDTH)
        if shares:
            s /= sums
            np.matmul(s, v, out=h)
        else:
            np.divide(np.matmul(s, v), sums, out=h)
        h += own[:, first:]
        return state, q, k, v, s

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Places of classes of several units, equal ones together, and (from, to, first rank, last rank) of each class."""
        starts = self.layout.starts
        places = np.flatnonzero((starts[1:] - starts[:-1] > 1)[cls])
        places = places[np.argsort(cls[places], kind="stable")]
        of = cls[places]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
        return places, [(a, z, int(starts[of[a]]), int(starts[of[a] + 1])) for a, z in zip(heads, [*heads[1:], len(of)][: len(heads)], strict=True)]

    def class_logs(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log probability of the classes."""
        out, at = self.weights[2], np.arange(len(cls))
        z = state @ out
        logs = z[at, cls]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            np.exp(z, out=z)
            logs -= np.log(_row_sums(z))
        low = ~np.isfinite(logs)
        if low.any():  # an overflow, in double precision
            z = state[low].astype(np.float64) @ out.astype(np.float64)
            top = z.max(1)
            logs[low] = z[np.arange(len(z)), cls[low]] - top - np.log(np.exp(z - top[:, None]).sum(1))
        return logs

    def add_leaf_logs(self, logs: np.ndarray, state: np.ndarray, unit: np.ndarray) -> None:
        """Adds the natural log probability of each unit within its class."""
        places, runs = self._by_class(self.layout.cls[unit])
        held, rank, more = state[places], self.layout.rank[unit[places]], np.empty(len(places), np.float32)
        for a, e, lo, hi in runs:
            for i in range(a, e, step := max(1, LEAF_CELLS // (hi - lo))):
                j = min(e, i + step)
                z = held[i:j] @ self.weights[3][lo:hi].T
                got = z[np.arange(j - i), rank[i:j] - lo]
                with np.errstate(over="ignore"):
                    sums = _row_sums(np.exp(z))
                if not (np.isfinite(sums).all() and sums.all()):
                    top = z.max(1)
                    got -= top
                    sums = np.exp(z - top[:, None]).sum(1)
                more[i:j] = got - np.log(sums)
        logs[places] += more

    def log_probabilities(self, x: np.ndarray, ok: np.ndarray, first: int, unit: np.ndarray) -> np.ndarray:
        """Natural log probability of the target units (windows, length - first)."""
        state, unit = self.states(x, first, ok, shares=False)[0], unit.ravel()
        logs = self.class_logs(state, self.layout.cls[unit])
        self.add_leaf_logs(logs, state, unit)
        return logs.reshape(len(x), -1)


class Trainer:
    """Adam over windows of units (windows, LENGTH + 1), -1 where a text has ended."""

    def __init__(self, model: Attention, rate: float, seed: int = 2):
        self.model, self.rate = model, rate
        self.rng = np.random.default_rng(seed)
        self.first = [np.zeros_like(w) for w in model.weights[:3]]
        self.second = [np.zeros_like(w) for w in model.weights]
        self.steps = self.seen = 0

    def gradients(self, windows: np.ndarray, leaf_step=None) -> tuple[float, list[np.ndarray]]:
        """Mean loss of the targets and its gradient by rows, bias and out; leaf_step(lo, hi, gradient) takes that of leaves."""
        layout, (table, bias, out, leaves) = self.model.layout, self.model.weights
        x, y = layout.row[np.maximum(windows[:, :-1], 0)], windows[:, 1:].ravel()
        real, y = y >= 0, np.maximum(y, 0)
        cls, n, at = layout.cls[y], len(y), np.arange(len(y))
        state, q, k, v, s = self.model.states(x)
        weight = real.astype(np.float32) / max(1, int(real.sum()))
        d_out, d_state, share = np.zeros_like(out), np.empty((n, WIDTH), np.float32), np.empty(n, np.float32)
        for a in range(0, n, ROWS):  # so many that their classes stay in a core's cache
            own = state[a : a + ROWS]
            z, sums = _softmax_parts(own @ out, lambda own=own: own @ out)
            cell = at[: len(own)] * z.shape[1] + cls[a : a + ROWS]
            got, scale = z.ravel()[cell], (weight[a : a + ROWS] / sums)[:, None]
            z.ravel()[cell] = got - sums
            share[a : a + ROWS] = got / sums
            d_out += np.ascontiguousarray((own * scale).T) @ z
            np.multiply(z @ out[:WIDTH].T, scale, out=d_state[a : a + ROWS])
        places, runs = self.model._by_class(cls)
        held, rank, own = state[places], layout.rank[y[places]], weight[places]
        leaf, d_held = np.empty(len(places), np.float32), np.empty((len(places), WIDTH), np.float32)
        for group in self._groups(runs):
            self._leaves(group, held, rank, own, leaf, d_held, leaf_step)
        d_state[places] += d_held
        loss = -float(np.log(share + 1e-30) @ weight + np.log(leaf + 1e-30) @ own)
        dh = d_state.reshape(x.shape[0], LENGTH, WIDTH)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        g = np.empty((*x.shape, 4 * WIDTH), np.float32)
        g[..., 2 * WIDTH : 3 * WIDTH] = np.matmul(s.transpose(0, 2, 1), dh)
        g[..., 3 * WIDTH :] = dh
        ds *= s
        ds -= _row_sums(ds)[..., None] * s
        d_bias = np.bincount(np.maximum(GAP, 0).ravel(), weights=np.where(GAP >= 0, ds.sum(0), 0).ravel(), minlength=LENGTH).astype(np.float32)
        ds *= np.float32(1 / math.sqrt(WIDTH))
        g[..., :WIDTH] = np.matmul(ds, k)
        g[..., WIDTH : 2 * WIDTH] = np.matmul(ds.transpose(0, 2, 1), q)
        flat = x.ravel()
        by_row = np.argsort(flat.astype(np.uint16) if layout.rows < 1 << 16 else flat, kind="stable")
        of = flat[by_row]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        d_table = np.zeros_like(table)
        pairs = g.reshape(-1, 4 * WIDTH)[by_row].view(np.complex64)  # two numbers are added at once
        d_table[of[heads]] = np.add.reduceat(pairs, heads, axis=0).view(np.float32)
        return loss, [d_table, d_bias, d_out]

    @staticmethod
    def _groups(runs: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
        """Neighbouring classes of one size, unless they are large; others by themselves."""
        held: list[tuple[int, int, int, int]] = []
        for r in runs:
            if held and not (r[2] == held[-1][3] and r[3] - r[2] == held[-1][3] - held[-1][2] <= GROUPED):
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def _leaves(self, group: list, held: np.ndarray, rank: np.ndarray, own: np.ndarray, leaf: np.ndarray, d_held: np.ndarray, leaf_step) -> None:
        """Shares of units within the group's classes, and the gradients: products by class, all else at once."""
        a, e, lo, hi = group[0][0], group[-1][1], group[0][2], group[-1][3]
        each, u, weight = group[0][3] - lo, self.model.weights[3], own[a:e]

        def products() -> np.ndarray:
            z = np.empty((e - a, each), np.float32)
            for b, f, first, last in group:
                np.matmul(held[b:f], u[first:last].T, out=z[b - a : f - a])
            return z

        z, sums = _softmax_parts(products(), products)
        cell = np.arange(0, z.size, each) + (rank[a:e] - lo) % each
        leaf[a:e] = z.ravel()[cell] / sums
        z *= (weight / sums)[:, None]
        z.ravel()[cell] -= weight
        change = np.empty((hi - lo, WIDTH + 1), np.float32)
        for b, f, first, last in group:
            np.matmul(z[b - a : f - a], u[first:last, :WIDTH], out=d_held[b:f])
            np.matmul(z[b - a : f - a].T, held[b:f], out=change[first - lo : last - lo])
        if leaf_step:
            leaf_step(lo, hi, change)

    def step(self, windows: np.ndarray) -> float:
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 20) / (1 + self.steps / 500)
        leaves, spread = self.model.weights[3], self.second[3]

        def leaf_step(lo: int, hi: int, g: np.ndarray) -> None:
            v = spread[lo:hi]
            v *= np.float32(0.99)
            change = g * g
            change *= np.float32(0.01)
            v += change
            np.sqrt(v, out=change)
            change += np.float32(1e-5)
            np.divide(g, change, out=change)
            change *= np.float32(rate)
            leaves[lo:hi] -= change

        loss, gradients = self.gradients(windows, leaf_step)
        for w, g, m, v in zip(self.model.weights, gradients, self.first, self.second, strict=False):
            m += np.float32(0.1) * (g - m)
            change = g * g
            change -= v
            change *= np.float32(0.01)
            v += change
            np.multiply(v, np.float32(1 / (1 - 0.99**self.steps)), out=change)
            np.sqrt(change, out=change)
            change += np.float32(1e-7)
            np.divide(m, change, out=change)
            change *= np.float32(rate / (1 - 0.9**self.steps))
            w -= change
        return loss

    def train(self, windows: np.ndarray, epochs: int = 1) -> None:
        """Every window once an epoch, in a random order."""
        for _ in range(epochs):
            order = self.rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                self.step(windows[order[a : a + BATCH]])
        self.seen += len(windows)


def training_windows(units: np.ndarray, bounds: np.ndarray, at_once: int = 16384) -> Iterator[np.ndarray]:
    """Windows of LENGTH + 1 units that hold each unit as a target once; -1 after a text's end, an end (0) before it."""
    size = np.diff(bounds)
    per = -(-size // LENGTH)
    text = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    for a in range(0, len(text), at_once):
        t = text[a : a + at_once]
        at = (nth[a : a + at_once] * LENGTH)[:, None] + np.arange(LENGTH + 1)[None, :]
        unit = units[np.clip(bounds[t][:, None] + at - 1, 0, len(units) - 1)]
        yield np.where(at > size[t][:, None], -1, np.where(at > 0, unit, 0)).astype(np.int32)


def text_scores(model: Attention, units: np.ndarray, bounds: np.ndarray, at_once: int = 128, held: int = 32) -> np.ndarray:
    """Natural log probability of each text: windows that overlap by half, each unit scored once.

    States come from at_once windows at a time; the units within classes are scored for `held` times as many.
    """
    sizes = np.diff(bounds)
    per = -(-sizes // STEP)
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    total = np.zeros(len(sizes))
    if not len(text):
        return total
    end = model.layout.row[0]
    rows = np.concatenate([np.full(STEP + 1, end), model.layout.row[units], np.full(LENGTH, end)])
    inputs = np.lib.stride_tricks.sliding_window_view(rows, LENGTH)  # of each target, the unit before it
    goals = np.lib.stride_tricks.sliding_window_view(np.concatenate([units, np.zeros(STEP, units.dtype)]), STEP)
    starts, reach = bounds[text] + nth * STEP, np.arange(-STEP, STEP)
    edge = (nth == 0) | ((nth + 1) * STEP > sizes[text])  # windows that reach out of their text
    for first in range(0, len(text), at_once * held):
        many = slice(first, first + at_once * held)
        unit = goals[starts[many]].ravel()
        cls = model.layout.cls[unit]
        state, logs = np.empty((len(unit), WIDTH + 1), np.float32), np.empty(len(unit), np.float32)
        for a in range(0, len(unit) // STEP, at_once):
            now = slice(first + a, min(first + a + at_once, many.stop))
            own = slice(a * STEP, (a + at_once) * STEP)
            x, ok = inputs[starts[now]], None
            x[nth[now] == 1, 0] = end  # before the text's first unit
            odd = np.flatnonzero(edge[now])
            if len(odd):
                at = nth[now][odd][:, None] * STEP + reach
                x[odd] = np.where(at > 0, x[odd], end)
                ok = np.ones(x.shape, bool)
                ok[odd] = (at >= 0) & (at < sizes[text[now][odd]][:, None])
            state[own] = model.states(x, STEP, ok, shares=False)[0]
            logs[own] = model.class_logs(state[own], cls[own])
        model.add_leaf_logs(logs, state, unit)
        odd = np.flatnonzero(edge[many])
        logs = logs.reshape(-1, STEP)
        logs[odd] = np.where(nth[many][odd][:, None] * STEP + reach[STEP:] < sizes[text[many][odd]][:, None], logs[odd], 0)
        total += np.bincount(text[many], weights=logs.sum(1, dtype=np.float64), minlength=len(sizes))
    return total
