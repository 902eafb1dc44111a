"""A small causal self-attention language model over subword ids, in numpy.

One attention layer; queries, keys and values are tables by id, so nothing is projected when scoring.  The next id's
probability is that of its class times that within the class.  The first ``starts`` classes hold the ids that may begin
a word, so the probability that a word ends is their sum.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
STRIDE, CONTEXT = 24, 8  # ids a window scores; ids before them that it sees
SPAN = STRIDE + CONTEXT
GROUP = 32  # ids of a class
CHUNK = 256  # windows attended at once: their weights stay in cache
FAR = np.float32(-1e9)
HIGH, LOW = np.float32(60), np.float32(1e-30)  # learning takes logits up to HIGH: cheaper than the maximum of short rows


class Room:
    """Arrays that are used again from chunk to chunk, so that memory is not asked for and given back each time."""

    def __init__(self):
        self.flat: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.flat or len(self.flat[name]) < size:
            self.flat[name] = np.empty(size, np.float32)
        return self.flat[name][:size].reshape(shape)


class Attention:
    """Parameters and their use.  Ids are 0 .. ids-1; the id ``ids`` pads and is never seen."""

    def __init__(self, ids: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.ids, self.groups = ids, -(-(ids + 1) // GROUP)
        rows, self.room = self.groups * GROUP, Room()
        scale = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"q": scale(rows, WIDTH), "k": scale(rows, WIDTH), "v": scale(rows, WIDTH), "e": scale(rows, WIDTH), "near": np.zeros(SPAN, np.float32), "c": scale(WIDTH, self.groups), "c0": np.zeros(self.groups, np.float32), "m": scale(self.groups, GROUP, WIDTH), "m0": np.zeros((self.groups, GROUP), np.float32)}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = np.asarray(flat[at : at + x.size], np.float32).reshape(x.shape)
            at += x.size

    def _bias(self) -> np.ndarray:
        """Additive (queries, keys): a learned bias by distance; keys after the query are masked."""
        gap = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(SPAN)[None, :]
        return np.where(gap >= 0, self.p["near"][np.maximum(gap, 0)], FAR).astype(np.float32)

    def _attend(self, x: np.ndarray) -> tuple:
        """x (windows, SPAN) of ids -> hidden states of the last STRIDE positions and a column of ones, and what the gradient
        needs: scaled queries, keys, values, weights before they are divided, what divides them, weighted values."""
        p, room, n, own = self.p, self.room, len(x), x[:, CONTEXT:]
        q = np.take(p["q"], own, axis=0, out=room("q", n, STRIDE, WIDTH), mode="clip")
        k = np.take(p["k"], x, axis=0, out=room("k", n, SPAN, WIDTH), mode="clip")
        v = np.take(p["v"], x, axis=0, out=room("v", n, SPAN, WIDTH), mode="clip")
        q *= np.float32(WIDTH**-0.5)
        s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", n, STRIDE, SPAN))
        s += self._bias()
        begins = np.flatnonzero(x[:, 0] == self.ids)  # padding is on the left of what a text's first window sees
        if len(begins):
            s[begins] += np.where(x[begins] == self.ids, FAR, np.float32(0))[:, None, :]
        np.exp(np.minimum(s, HIGH, out=s), out=s)
        r = (1 / (s @ np.ones(SPAN, np.float32) + LOW))[:, :, None]
        o = np.matmul(s, v, out=room("o", n, STRIDE, WIDTH))
        o *= r
        h = room("h", n, STRIDE, WIDTH + 1)
        h[:, :, WIDTH] = 1
        z = np.take(p["e"], own, axis=0, out=room("e", n, STRIDE, WIDTH), mode="clip")
        z += o
        np.tanh(z, out=h[:, :, :WIDTH])
        return h.reshape(-1, WIDTH + 1), q, k, v, s, r, o

    def prepare(self) -> dict:
        """The tables as scoring uses them.

        Keys are scaled.  Values have a column of ones, whose weighted sum is the weights' sum; divided by it, the column
        carries the output biases.  With values and ``e`` doubled, tanh(z) is 1 - 2 u, u = 1 / (1 + exp(2 z)), and what is
        linear in that goes into the output layers.
        """
        p = self.p
        k = p["k"] * np.float32(WIDTH**-0.5)
        norm = lambda m: float(np.sqrt((m * m).sum(1).max()))
        add = lambda m, column: np.concatenate([m, np.broadcast_to(column, (*m.shape[:-1], 1))], axis=-1, dtype=np.float32)
        layer = lambda m, bias: np.ascontiguousarray(add(-2 * m, (bias + m.sum(-1))[..., None]))
        small = norm(p["q"]) * norm(k) + float(np.abs(p["near"]).max()) < 60
        e = add(2 * p["e"], np.float32(-41))  # 1 - 41: u is 1
        return {"k": k, "v": add(2 * p["v"], np.float32(1)), "e": e, "bias": self._bias(), "small": small, "c": layer(p["c"].T, p["c0"]).T.copy(), "m": layer(p["m"], p["m0"]).transpose(0, 2, 1).copy(), "ones": np.ones(max(self.groups, GROUP), np.float32), "room": Room()}

    def _hidden(self, x: np.ndarray, r: dict) -> np.ndarray:
        """(windows * STRIDE, WIDTH + 1) that the prepared output layers take."""
        own, n = x[:, CONTEXT:], len(x)
        room = r["room"]
        q = np.take(self.p["q"], own, axis=0, out=room("q", n, STRIDE, WIDTH), mode="clip")
        k = np.take(r["k"], x, axis=0, out=room("k", n, SPAN, WIDTH), mode="clip")
        v = np.take(r["v"], x, axis=0, out=room("v", n, SPAN, WIDTH + 1), mode="clip")
        s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", n, STRIDE, SPAN))
        s += r["bias"]
        begins = np.flatnonzero(x[:, CONTEXT - 1] == self.ids)  # a text's first window has padding before it
        if len(begins):
            s[begins] += np.where(x[begins] == self.ids, FAR, np.float32(0))[:, None, :]
        if not r["small"]:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        h = np.matmul(s, v, out=room("h", n, STRIDE, WIDTH + 1)).reshape(-1, WIDTH + 1)
        h *= 1 / h[:, WIDTH:]
        h += np.take(r["e"], own.ravel(), axis=0, out=room("e", len(h), WIDTH + 1), mode="clip")
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += np.float32(1)
        return np.reciprocal(h, out=h)

    def log_probs(self, x: np.ndarray, y: np.ndarray, ready: dict | None = None, starts: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities (windows, STRIDE): of the ids y that follow, and that a first-``starts``-class id follows."""
        out, r = np.empty(y.shape, np.float32), ready or self.prepare()
        begun, room = np.empty(y.shape, np.float32), r["room"]
        sums = np.ones((self.groups, 2), np.float32)
        sums[starts:, 1] = 0
        for a in range(0, len(x), CHUNK):
            h = self._hidden(x[a : a + CHUNK], r)
            t = y[a : a + CHUNK].ravel()
            n = len(t)
            group = t // GROUP
            order = np.argsort(group.astype(np.int16), kind="stable")
            sorted_h, sorted_t = np.take(h, order, axis=0, out=room("sorted", n, WIDTH + 1), mode="clip"), t[order]
            z = np.matmul(sorted_h, r["c"], out=room("z", n, self.groups))
            value = z[np.arange(n), sorted_t // GROUP]
            np.exp(z, out=z)
            ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=self.groups))]).tolist()
            w = room("w", n, GROUP)
            for g, (i, j) in enumerate(zip(ends, ends[1:])):
                if i < j:
                    np.matmul(sorted_h[i:j], r["m"][g], out=w[i:j])
            value += w[np.arange(n), sorted_t % GROUP]
            np.exp(w, out=w)
            mass = z @ sums
            value -= np.log(mass[:, 0] * (w @ r["ones"][:GROUP]))
            at = a * STRIDE + order
            out.ravel()[at] = value
            begun.ravel()[at] = np.log(mass[:, 1] / mass[:, 0] + np.float32(1e-30))
        return out, begun

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the ids y that are not padding, and its gradient.

        Positions are sorted by their targets' classes.  Attention weights stay undivided: what divides them goes into the
        narrower arrays they meet, and the sum of weights and their gradients is that of weighted values and theirs.
        """
        p, room, size = self.p, self.room, len(x)
        h, q, k, v, s, r, o = self._attend(x)
        order = np.argsort((y.ravel() // GROUP).astype(np.int16), kind="stable")
        t, n = y.ravel()[order], np.arange(y.size)
        group, member = t // GROUP, t % GROUP
        ends = np.searchsorted(group, np.arange(self.groups + 1)).tolist()
        parts = [(c, i, j) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
        real = (t != self.ids).astype(np.float32)
        real /= max(1.0, float(real.sum(dtype=np.float64)))
        h = np.take(h, order, axis=0, out=room("sorted", len(t), WIDTH + 1), mode="clip")

        def softmax_less_target(z, target):
            """Loss; z becomes its gradient."""
            np.exp(np.minimum(z, HIGH, out=z), out=z)
            total = z @ np.ones(z.shape[1], np.float32) + LOW
            loss = -float((real * np.log(z[n, target] / total + 1e-30)).sum())
            z *= (real / total)[:, None]
            z[n, target] -= real
            return loss

        g = {name: np.zeros_like(z) for name, z in p.items()}
        z = np.matmul(h, np.concatenate([p["c"], p["c0"][None]]), out=room("z", len(t), self.groups))
        loss = softmax_less_target(z, group)
        both = h.T @ z
        g["c"], g["c0"] = both[:WIDTH], both[WIDTH]
        dh = np.matmul(z, p["c"].T, out=room("dh", len(t), WIDTH))
        m, w = np.concatenate([p["m"], p["m0"][:, :, None]], axis=2), room("w", len(t), GROUP)
        for c, i, j in parts:
            np.matmul(h[i:j], m[c].T, out=w[i:j])
        loss += softmax_less_target(w, member)
        within = room("within", len(t), WIDTH)
        for c, i, j in parts:
            both = w[i:j].T @ h[i:j]
            g["m"][c], g["m0"][c] = both[:, :WIDTH], both[:, WIDTH]
            np.matmul(w[i:j], p["m"][c], out=within[i:j])
        dh += within
        h = h[:, :WIDTH]
        dh *= 1 - h * h
        by_own, by_all = room("by own", size, STRIDE, 2 * WIDTH), room("by all", size, SPAN, 2 * WIDTH)
        d = room("d", size, STRIDE, WIDTH)
        d.reshape(-1, WIDTH)[order] = dh
        by_own[:, :, :WIDTH] = d
        d *= r
        np.matmul(s.transpose(0, 2, 1), d, out=by_all[:, :, :WIDTH])
        ds = np.matmul(d, v.transpose(0, 2, 1), out=room("ds", size, STRIDE, SPAN))
        ds -= np.einsum("wij,wij->wi", d, o)[:, :, None]
        ds *= s
        gap = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(SPAN)[None, :]
        g["near"] = np.bincount(gap[gap >= 0], ds.sum(0)[gap >= 0], SPAN).astype(np.float32)
        np.matmul(ds, k, out=by_own[:, :, WIDTH:])
        np.matmul(ds.transpose(0, 2, 1), q, out=by_all[:, :, WIDTH:])
        own, every = _sums(x[:, CONTEXT:].ravel(), len(p["e"]), by_own), _sums(x.ravel(), len(p["e"]), by_all)
        g["e"], g["q"], g["v"], g["k"] = own[:, :WIDTH], own[:, WIDTH:] * np.float32(WIDTH**-0.5), every[:, :WIDTH], every[:, WIDTH:]
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, rate: float, batch: int = 128, seed: int = 0) -> float:
        """Adam for at least ``steps`` steps and at least one pass over the windows; the last steps' mean loss."""
        rng = np.random.default_rng(seed)
        flat = self.flat()
        self.load(flat)  # the parameters are views of an array of their own: what was loaded stays as it is
        first, second, some = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        total, losses = max(steps, -(-len(x) // batch)), []
        order = np.zeros(0, np.int64)
        for t in range(1, total + 1):
            if not len(order):  # a pass ends with a smaller batch
                order = rng.permutation(len(x))
            pick, order = order[:batch], order[batch:]
            loss, g = self.gradient(x[pick].astype(np.int32), y[pick].astype(np.int32))
            losses.append(loss)
            lr = rate * min(1.0, t / 20) * (1 - 0.9 * t / total)
            slope = np.concatenate([g[k].ravel() for k in self.p])
            first += np.multiply(np.subtract(slope, first, out=some), np.float32(0.1), out=some)
            slope *= slope
            second += np.multiply(np.subtract(slope, second, out=some), np.float32(0.01), out=some)
            np.sqrt(np.multiply(second, np.float32(1 / (1 - 0.99**t)), out=some), out=some)
            some += np.float32(1e-8)
            np.divide(first, some, out=some)
            some *= np.float32(lr / (1 - 0.9**t))
            flat -= some
        return float(np.mean(losses[-20:])) if losses else 0.0


def _sums(ids: np.ndarray, rows: int, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors by the ids at their places, a table of ``rows``."""
    width, number = vectors.shape[-1], np.bincount(ids, minlength=rows)
    seen = np.flatnonzero(number)
    out = np.zeros((rows, width), np.float32)
    order = np.argsort(ids.astype(np.int16), kind="stable")
    out[seen] = np.add.reduceat(np.take(vectors.reshape(-1, width), order, axis=0, mode="clip"), (np.cumsum(number) - number)[seen], axis=0)
    return out


def windows(texts: list[np.ndarray], pad: int, before: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows that score every id of each sequence but its first once.

    before: up to CONTEXT ids that come before each sequence and are only seen.  Returns inputs (windows, SPAN), targets (windows, STRIDE; pad where there is none) and windows of each text.
    """
    number = np.array([-(-(len(s) - 1) // STRIDE) for s in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(number * STRIDE + CONTEXT)])
    line = np.full(max(SPAN, begin[-1] + 1), pad, np.int32)
    for s, b in zip(texts, begin.tolist()):
        line[b + CONTEXT : b + CONTEXT + len(s) - 1] = s[:-1]
    for lead, b in zip(before or [], begin.tolist()):
        line[b + CONTEXT - len(lead) : b + CONTEXT] = lead
    goal = np.full(len(line), pad, np.int32)
    for s, b in zip(texts, begin.tolist()):
        goal[b + CONTEXT : b + CONTEXT + len(s) - 1] = s[1:]
    start = np.repeat(begin[:-1], number) + (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * STRIDE
    rows = np.lib.stride_tricks.sliding_window_view
    return rows(line, SPAN)[start], rows(goal, STRIDE)[start + CONTEXT], number
