"""A small causal self-attention model in numpy: one layer over subword slots, with a two-level output softmax.

Slots are the most frequent subword ids and one slot for all the rest. A position sees its window up to itself; its state
gives the class of the next slot and the slot within the class, so the probabilities of all slots sum to one at a cost of
two short softmaxes.
"""

from __future__ import annotations

import math

import numpy as np

#: Scores before an exponential are held within these bounds when texts are scored: no sum overflows or is zero.
_BOUND = np.float32(60)
SHAPES = ("embed", "place", "query", "key", "value", "carry", "out", "bias", "class_w", "class_b", "slot_w", "slot_b")


def shapes(slots: int, per_class: int, width: int, window: int) -> dict[str, tuple[int, ...]]:
    classes = slots // per_class
    square = (width, width)
    sizes = ((slots, width), (window, width), square, square, square, square, square, (width,),
             (width, classes), (classes,), (classes, width, per_class), (classes, per_class))
    return dict(zip(SHAPES, sizes))


class Attention:
    """Parameters as one float32 vector (``flat``), and views into it by name."""

    def __init__(self, slots: int = 1024, per_class: int = 32, width: int = 16, window: int = 32, flat: np.ndarray | None = None):
        self.slots, self.per_class, self.width, self.window = slots, per_class, width, window
        self.shapes = shapes(slots, per_class, width, window)
        ends = np.cumsum([math.prod(s) for s in self.shapes.values()]).tolist()
        self.places = [(name, slice(lo, hi), shape) for (name, shape), lo, hi in zip(self.shapes.items(), [0, *ends], ends)]
        size, self.rooms = ends[-1], {}
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        self.at = self._views(self.flat)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[part].reshape(shape) for name, part, shape in self.places}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, the same memory for the same name: batches follow each other without new pages."""
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def start(self, counts: np.ndarray, seed: int = 0) -> Attention:
        """Small random weights, and biases that make every state give the slots' own frequencies."""
        draw = np.random.default_rng(seed)
        for name, array in self.at.items():
            if array.ndim > 1 and name != "slot_b":
                array[...] = draw.normal(0, 0.3 if name in ("embed", "place") else 1 / np.sqrt(self.width), array.shape)
        for name in ("class_w", "slot_w", "place"):
            self.at[name] *= 0.3
        share = (counts + 0.5).reshape(-1, self.per_class)
        self.at["class_b"][...] = np.log(share.sum(axis=1) / share.sum())
        self.at["slot_b"][...] = np.log(share / share.sum(axis=1, keepdims=True))
        return self

    def _by_class(self, target: np.ndarray):
        """Rows in order of the target's class: ``(order, edges)``."""
        kind = (target // self.per_class).astype(np.uint8 if self.slots // self.per_class <= 256 else np.uint16)
        order = np.argsort(kind, kind="stable")
        return order, np.searchsorted(kind[order], np.arange(self.slots // self.per_class + 1))

    def log_prob(self, state: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target slot at its state, a row of :meth:`states`."""
        class_w, slot_w = self.outputs
        each, kind = np.arange(len(target)), target // self.per_class
        out = _log_share(state @ class_w, each, kind)
        order, edges = self._by_class(target)
        own, z = np.take(state, order, axis=0), np.empty((len(target), self.per_class), np.float32)
        for c in np.flatnonzero(np.diff(edges)):
            np.matmul(own[edges[c]:edges[c + 1]], slot_w[c], out=z[edges[c]:edges[c + 1]])
        out[order] += _log_share(z, each, (target % self.per_class)[order])
        return out

    def prepare(self) -> None:
        """Projections of every slot and place, so that scoring looks them up instead of multiplying."""
        p = self.at
        scale = np.float32(1 / np.sqrt(self.width))
        self.tables = {n: (p["embed"] @ p[n], p["place"] @ p[n]) for n in ("query", "key", "value", "carry")}
        self.tables["query"] = tuple(t * scale for t in self.tables["query"])
        self.tables["carry"] = (self.tables["carry"][0], self.tables["carry"][1] + p["bias"])
        # what a position adds to a state that sees it: value and out act only through their product
        of_slot, of_place = (t @ p["out"] for t in self.tables["value"])
        self.tables["value"] = (np.pad(of_slot, ((0, 0), (0, 1)), constant_values=1), np.pad(of_place, ((0, 0), (0, 1))))
        # states end in a one, so that biases are a last row of the output weights
        self.outputs = self._outputs()

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        p = self.at
        return np.vstack((p["class_w"], p["class_b"])), np.concatenate((p["slot_w"], p["slot_b"][:, None, :]), axis=1)

    def states(self, ids: np.ndarray, first: int = 0) -> np.ndarray:
        """States of the positions from ``first`` on, for windows ``(n, window)`` of slots: ``(n, positions, width + 1)``."""
        (q, qp), (k, kp), (v, vp), (c, cp) = (self.tables[n] for n in ("query", "key", "value", "carry"))
        length = ids.shape[1]
        n, ids = len(ids), np.ascontiguousarray(ids)
        asked = np.ascontiguousarray(ids[:, first:])
        queries = np.take(q, asked, axis=0, out=self._room("queries", *asked.shape, self.width), mode="clip")
        keys = np.take(k, ids, axis=0, out=self._room("keys", n, length, self.width), mode="clip")
        values = np.take(v, ids, axis=0, out=self._room("values", n, length, self.width + 1), mode="clip")
        queries += qp[first:length]
        keys += kp[:length]
        values += vp[:length]
        weight = np.matmul(queries, keys.transpose(0, 2, 1), out=self._room("weight", n, length - first, length))
        np.clip(weight, -_BOUND, _BOUND, out=weight)
        np.exp(weight, out=weight)
        weight *= _mask(length)[first:]
        # the last column of the values is one: it gives the sums of the weights
        seen = np.matmul(weight, values, out=self._room("seen", n, length - first, self.width + 1))
        before = np.take(c, asked, axis=0, out=queries, mode="clip")
        before += cp[first:length]
        before += np.divide(seen[..., :-1], seen[..., -1:], out=self._room("shared", *before.shape))
        state = np.ones((*asked.shape, self.width + 1), np.float32)
        np.tanh(before, out=state[..., :-1])
        return state

    def gradient(self, ids: np.ndarray, target: np.ndarray, valid: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of the valid positions of a batch of windows, and its gradient.

        Key and query act only through their product, and so do value and out: both products are taken first, and the gradients
        of the four follow from those of the products.
        """
        p = self.at
        grad = np.zeros_like(self.flat)
        g = self._views(grad)
        n, w = ids.shape
        d, scale, classes = self.width, np.float32(1 / np.sqrt(self.width)), self.slots // self.per_class
        count, slot = n * w, ids.ravel()
        x = np.take(p["embed"], slot, axis=0, out=self._room("x", count, d), mode="clip")
        by_window = x.reshape(n, w, d)
        by_window += p["place"][:w]
        into = np.concatenate(((p["query"] @ p["key"].T) * scale, p["value"] @ p["out"], p["carry"]), axis=1)
        ahead = np.dot(x, into, out=self._room("ahead", count, 3 * d)).reshape(n, w, 3 * d)
        asked, told, carried = ahead[..., :d], ahead[..., d:2 * d], ahead[..., 2 * d:]
        a = np.matmul(asked, by_window.transpose(0, 2, 1), out=self._room("a", n, w, w))
        _shares(a.reshape(-1, w), _mask(w))
        o = np.matmul(a, told, out=self._room("o", n, w, d))
        carried += p["bias"]
        carried += o
        h = np.tanh(carried, out=self._room("h", n, w, d)).reshape(-1, d)
        # output layers, over the valid positions in order of the class of their target
        kind, at = np.divmod(target.ravel().astype(np.uint16), np.uint16(self.per_class))
        kind[~valid.ravel()] = classes
        m = int(np.count_nonzero(valid))
        order = np.argsort(kind.astype(np.uint8) if classes < 256 else kind, kind="stable")[:m]
        kind, each = kind[order], np.arange(m)
        edges = np.searchsorted(kind, np.arange(classes + 1, dtype=np.uint16)).tolist()
        # states end in a one, so that biases are a last row of the output weights
        own, state = np.take(h, order, axis=0, out=self._room("own", m, d), mode="clip"), self._room("state", m, d + 1)
        state[:, :d], state[:, d] = own, 1
        class_w, slot_w = self._outputs()
        prob = np.dot(state, class_w, out=self._room("prob", m, classes))
        _shares(prob)
        loss = _less_one(prob, each * classes + kind)
        both = np.dot(state.T, prob)
        g["class_w"][...], g["class_b"][...] = both[:d], both[d]
        back = np.dot(prob, p["class_w"].T, out=self._room("back", m, d))
        prob, more = self._room("share", m, self.per_class), self._room("more", m, d)
        some = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi]
        for c, part in some:
            np.dot(state[part], slot_w[c], out=prob[part])
        _shares(prob)
        loss += _less_one(prob, each * self.per_class + at[order])
        both, columns, turned = np.zeros_like(slot_w), state.T, p["slot_w"].transpose(0, 2, 1)
        for c, part in some:
            share = prob[part]
            np.dot(columns[:, part], share, out=both[c])
            np.dot(share, turned[c], out=more[part])
        g["slot_w"][...], g["slot_b"][...] = both[:, :d], both[:, d]
        back += more
        # the layer; the mean's division by m comes last
        own *= own
        np.subtract(np.float32(1), own, out=own)
        back *= own
        flat = self._room("flat", count, d)
        if m < count:
            flat.fill(0)
        flat[order] = back
        d_pre = flat.reshape(n, w, d)
        np.dot(_ones(count), flat, out=g["bias"])
        behind = self._room("behind", n, w, 3 * d)
        behind[..., 2 * d:] = d_pre
        np.matmul(a.transpose(0, 2, 1), d_pre, out=behind[..., d:2 * d])
        d_a = np.matmul(d_pre, told.transpose(0, 2, 1), out=self._room("d_a", n, w, w))
        o *= d_pre
        d_a -= np.dot(o.reshape(-1, d), _ones(d)).reshape(n, w, 1)
        d_a *= a
        np.matmul(d_a, by_window, out=behind[..., :d])
        d_x = np.matmul(d_a.transpose(0, 2, 1), asked, out=o).reshape(-1, d)
        behind = behind.reshape(-1, 3 * d)
        d_asks, d_tells, g["carry"][...] = np.split(x.T @ behind, 3, axis=1)
        d_asks = d_asks * scale
        g["query"][...], g["key"][...] = d_asks @ p["key"], d_asks.T @ p["query"]
        g["value"][...], g["out"][...] = d_tells @ p["out"].T, p["value"].T @ d_tells
        d_x += np.dot(behind, into.T, out=h)
        np.dot(_ones(n), d_x.reshape(n, -1), out=g["place"][:w].reshape(-1))
        cell = slot[:, None] * d + np.arange(d)
        g["embed"][...] = np.bincount(cell.reshape(-1), d_x.reshape(-1), self.slots * d).reshape(self.slots, d)
        grad *= np.float32(1 / m)
        return loss / m, grad

    def learn(self, ids: np.ndarray, target: np.ndarray, valid: np.ndarray, rate: float = 0.01, batch: int = 32, epochs: int = 1) -> None:
        """Adam over the windows, in their order."""
        mean, square, step = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        for _ in range(epochs):
            for lo in range(0, len(ids), batch):
                part = slice(lo, lo + batch)
                if not valid[part].any():
                    continue
                _, grad = self.gradient(ids[part], target[part], valid[part])
                step += 1
                # in place: mean += 0.1 * (grad - mean), square += 0.01 * (grad * grad - square)
                mean *= 0.9
                mean += grad * np.float32(0.1)
                grad *= grad
                grad *= 0.01
                square *= 0.99
                square += grad
                # rate * (mean / (1 - 0.9 ** step)) / (sqrt(square / (1 - 0.99 ** step)) + 1e-6), its fraction multiplied out
                high = (1 - 0.99 ** step) ** 0.5
                np.sqrt(square, out=grad)
                grad += 1e-6 * high
                np.divide(mean, grad, out=grad)
                grad *= rate * high / (1 - 0.9 ** step)
                self.flat -= grad


_MASKS: dict[int, np.ndarray] = {}
_ONES = np.ones(1 << 12, np.float32)


def _ones(length: int) -> np.ndarray:
    return _ONES[:length] if length <= len(_ONES) else np.ones(length, np.float32)


def _mask(length: int) -> np.ndarray:
    if length not in _MASKS:
        _MASKS[length] = np.tril(np.ones((length, length), np.float32))
    return _MASKS[length]


def _log_share(x: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at a column; ``x`` is used up."""
    np.clip(x, -_BOUND, _BOUND, out=x)
    picked = x[row, column]
    np.exp(x, out=x)
    picked -= np.log(np.dot(x, _ones(x.shape[1])))
    return picked


def _shares(x: np.ndarray, mask: np.ndarray | None = None) -> None:
    """Softmax of each row in place; rows are windows one after the other if a mask says what a place of a window sees."""
    np.clip(x, -_BOUND, _BOUND, out=x)
    np.exp(x, out=x)
    if mask is not None:
        by_window = x.reshape(-1, *mask.shape)
        by_window *= mask
    x /= np.dot(x, _ones(x.shape[1]))[:, None]


def _less_one(prob: np.ndarray, at: np.ndarray) -> float:
    """The loss of the shares at these places of the flattened array, which are then less by one."""
    every = prob.reshape(-1)
    picked = every[at]
    every[at] = picked - 1
    return -float(np.log(picked).sum(dtype=np.float64))
