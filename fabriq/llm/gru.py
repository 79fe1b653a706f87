"""A gated recurrent language model in numpy with a class-factored softmax.

Ids 0..words-1 are words, in classes of equal probability mass; ids from there are tail classes, which stand for all
words of a shape that are not among the words and have no softmax of their own.  Sequences run in lanes: documents follow one
another in a lane, the state is zeroed where one begins and carried through its windows to its end.
"""

from __future__ import annotations

import heapq

import numpy as np


def classes(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Class and place in it of each word, the words being sorted by count downwards; sizes of the classes."""
    mass = np.cumsum(np.sqrt(counts)) / np.sqrt(counts).sum()
    cls = np.minimum((mass * n).astype(int), n - 1)
    _, cls = np.unique(cls, return_inverse=True)
    first = np.searchsorted(cls, np.arange(cls.max() + 1))
    return cls, np.arange(len(cls)) - first[cls], np.bincount(cls).tolist()


def _softmax(logits: np.ndarray, bias: np.ndarray, every: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P of the picked column of each row, and all columns' P; works in place."""
    logits += bias
    np.clip(logits, -60, 60, out=logits)
    picked = logits[every, pick]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    logits /= total[:, None]
    return picked - np.log(total), logits


class GRU:
    def __init__(self, params: dict[str, np.ndarray], cls: np.ndarray, sizes: list[int], tails: int):
        self.p, self.sizes = params, sizes
        self.words = len(cls)
        self.cls = np.concatenate([cls, len(sizes) + np.arange(tails)])
        self.first = np.r_[0, np.cumsum(sizes)]

    @staticmethod
    def init(cls: np.ndarray, sizes: list[int], tails: int, hidden: int, counts: np.ndarray, seed: int = 7) -> GRU:
        rnd = np.random.default_rng(seed)
        words, n = len(cls), len(cls) + tails
        full = np.concatenate([cls, len(sizes) + np.arange(tails)])
        mass = np.bincount(full, counts + 1.0)
        g = lambda *s: (rnd.standard_normal(s) * 0.15).astype(np.float32)
        p = {"E": g(n, 3 * hidden), "U": g(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "c": np.zeros(hidden, np.float32), "C": g(hidden, len(sizes) + tails), "d": np.log(mass / mass.sum()).astype(np.float32), "W": g(hidden, words), "w": np.log((counts[:words] + 1) / mass[cls]).astype(np.float32)}
        return GRU(p, cls, sizes, tails)

    def step(self, x: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: gate inputs (B, 3H), b included; h: states (B, H)."""
        n = h.shape[1]
        u = h @ self.p["U"]
        zr = x[:, : 2 * n] + u[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :n], zr[:, n:]
        un = u[:, 2 * n :] + self.p["c"]
        a = np.tanh(x[:, 2 * n :] + r * un)
        if keep is not None:
            keep |= {"h": h, "z": z, "r": r, "un": un, "a": a}
        return a + z * (h - a)

    def log_probs(self, hs: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of the ids y after the states hs; with grads, the gradients of -sum are added there and the states' returned."""
        p = self.p
        c = self.cls[y]
        every = np.arange(len(y))
        out, d = _softmax(hs @ p["C"], p["d"], every, c)
        dh = None
        if grads is not None:
            d[every, c] -= 1
            grads["C"] += hs.T @ d
            grads["d"] += d.sum(axis=0)
            dh = d @ p["C"].T
        inside = np.flatnonzero(y < self.words)
        order = inside[np.argsort(c[inside], kind="stable")]
        cuts = np.searchsorted(c[order], np.arange(len(self.sizes) + 1))
        for k in range(len(self.sizes)):
            at = order[cuts[k] : cuts[k + 1]]
            if not len(at) or self.sizes[k] == 1:
                continue
            lo, hi = self.first[k], self.first[k + 1]
            part = hs[at]
            own = y[at] - lo
            every = np.arange(len(at))
            got, d = _softmax(part @ p["W"][:, lo:hi], p["w"][lo:hi], every, own)
            out[at] += got
            if grads is not None:
                d[every, own] -= 1
                grads["W"][:, lo:hi] += part.T @ d
                grads["w"][lo:hi] += d.sum(axis=0)
                dh[at] += d @ p["W"][:, lo:hi].T
        return out, dh

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, h: np.ndarray, end: int) -> tuple[np.ndarray, dict, np.ndarray, np.ndarray]:
        """One window (steps, lanes) of ids x, before y: the states after it, the gradients of -sum ln P of the real places, and those of E's rows."""
        p, hidden, lanes = self.p, h.shape[1], x.shape[1]
        kept, hs = [], []
        for t in range(len(x)):
            fresh = (x[t] != end)[:, None]
            k = {"fresh": fresh}
            h = self.step(p["E"][x[t]] + p["b"], h * fresh, k)
            kept.append(k)
            hs.append(h)
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
        of = real.ravel()
        dh = np.zeros((len(of), hidden), h.dtype)
        _, dh[of] = self.log_probs(np.concatenate(hs)[of], y.ravel()[of], g)
        dh = dh.reshape(len(x), lanes, hidden)
        carry = np.zeros((lanes, hidden), h.dtype)
        dx = np.empty((len(x), lanes, 3 * hidden), h.dtype)
        for t in range(len(x) - 1, -1, -1):
            k = kept[t]
            d = dh[t] + carry
            da = d * (1 - k["z"]) * (1 - k["a"] ** 2)
            dz = d * (k["h"] - k["a"]) * k["z"] * (1 - k["z"])
            dun = da * k["r"]
            dr = da * k["un"] * k["r"] * (1 - k["r"])
            dx[t] = np.concatenate([dz, dr, da], axis=1)
            du = np.concatenate([dz, dr, dun], axis=1)
            g["U"] += k["h"].T @ du
            g["c"] += dun.sum(axis=0)
            carry = (d * k["z"] + du @ p["U"].T) * k["fresh"]
        flat = dx.reshape(-1, 3 * hidden)
        g["b"] += flat.sum(axis=0)
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        rows, starts = np.unique(ids[order], return_index=True)
        return h, g, rows, np.add.reduceat(flat[order], starts, axis=0)

    def train(self, docs: list[np.ndarray], end: int, lanes: int = 256, window: int = 20, rate: float = 0.15, passes: int = 1, seed: int = 0) -> None:
        """Truncated backpropagation with Adagrad over documents (each ends with end)."""
        p, hidden = self.p, self.p["U"].shape[0]
        sq = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        rnd = np.random.default_rng(seed)
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        for _ in range(passes):
            flow = np.concatenate([docs[i] for i in rnd.permutation(len(docs))])
            before = np.r_[end, flow[:-1]]
            lanes = max(1, min(lanes, len(flow) // (16 * window)))  # few tokens make small batches, so that a pass has many steps
            steps = -(-len(flow) // lanes)
            rest = steps * lanes - len(flow)  # places after the flow's end, which teach nothing
            y, x = (np.r_[v, np.full(rest, end, v.dtype)].reshape(lanes, steps).T for v in (flow, before))
            real = (np.arange(steps * lanes) < len(flow)).reshape(lanes, steps).T
            h = np.zeros((lanes, hidden), np.float32)
            for lo in range(0, steps, window):
                hi = min(steps, lo + window)
                h, g, rows, ge = self.gradients(x[lo:hi], y[lo:hi], real[lo:hi], h, end)
                scale = 1 / lanes
                for k, v in g.items():
                    v *= scale
                    np.clip(v, -5, 5, out=v)
                    sq[k] += v * v
                    p[k] -= rate * v / np.sqrt(sq[k])
                ge = np.clip(ge * scale, -5, 5)
                sq["E"][rows] += ge * ge
                p["E"][rows] -= rate * ge / np.sqrt(sq["E"][rows])

    def score(self, flow: np.ndarray, at: np.ndarray, end: int, lanes: int = 192, chunk: int = 48) -> np.ndarray:
        """log10 P of each document: flow has all ids, document k those from at[k] to at[k+1], its end included.

        Memory goes with the number of ids and with lanes * chunk, not with the longest document times the lanes.
        """
        p, hidden = self.p, self.p["U"].shape[0]
        n = np.diff(at)
        lanes = max(1, min(lanes, len(n)))
        # documents to lanes, the longest first, each to the shortest lane
        heap, where = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for d in np.argsort(-n, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            where[k].append(d)
            heapq.heappush(heap, (size + int(n[d]), k))
        where = sorted((w for w in where if w), key=lambda w: -sum(n[d] for d in w))
        lengths = np.array([sum(int(n[d]) for d in w) for w in where])
        order = np.concatenate([np.array(w) for w in where]) if where else np.zeros(0, np.int64)
        ids = np.concatenate([flow[at[d] : at[d + 1]] for d in order.tolist()]) if where else flow
        own = np.repeat(order, n[order]).astype(np.int32)  # lane after lane
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        out = np.zeros(len(n))
        table = p["E"] + p["b"]
        h = np.zeros((len(where), hidden), np.float32)
        last = np.full(len(where), end, np.int32)
        for lo in range(0, int(lengths.max()) if where else 0, chunk):
            hs, ys, ds = [], [], []
            for t in range(lo, min(int(lengths[0]), lo + chunk)):
                live = int(np.searchsorted(-lengths, -t))  # lanes are sorted by length
                h, last = h[:live], last[:live]
                h = self.step(table[last], h * (last != end)[:, None])
                spot = begin[:live] + t
                last = ids[spot]
                hs.append(h)
                ys.append(last)
                ds.append(own[spot])
            got, _ = self.log_probs(np.concatenate(hs), np.concatenate(ys))
            out += np.bincount(np.concatenate(ds), got, len(n))
        return out / np.log(10)
