"""A small causal self-attention language model over subword ids, in numpy.

One attention layer with a bias per relative position, one hidden layer, and an
output in two steps: the class of the next id, then the id within its class.
Classes hold ids of like frequency, and the output biases start from counted
frequencies, so that an untrained model is the unigram model of the counts.

A sequence is cut into blocks of ``STRIDE`` positions. A window is a block and
the ``CONTEXT`` positions before it; windows overlap by these, every id is
scored once, in the window whose block it stands in, and a mask keeps padding
and later positions out. Windows are scored many at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np

IDS = 2048
END = IDS - 1
PAD = IDS
WIDE = 32  # ids in a class
CLASSES = IDS // WIDE
DIM, HIDDEN = 16, 24
STRIDE, CONTEXT = 24, 8
WINDOW = STRIDE + CONTEXT
BATCH = 256
RATE = 1.2e-2
SHAPES = {
    "emb": (IDS + 1, DIM), "wq": (DIM, DIM), "wk": (DIM, DIM), "wv": (DIM, DIM), "near": (WINDOW,),
    "w1": (DIM, HIDDEN), "w2": (DIM, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wi": (CLASSES, HIDDEN, WIDE), "bi": (CLASSES, WIDE),
}
_back = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(WINDOW)[None, :]
_causal = (_back >= 0).astype(np.float32)
_distance = np.maximum(_back, 0)


@dataclass
class Model:
    params: dict[str, np.ndarray]
    place: np.ndarray  # of each id: class * WIDE + number in the class

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in SHAPES])

    def with_flat(self, flat: np.ndarray) -> "Model":
        out, at = {}, 0
        for k, shape in SHAPES.items():
            n = int(np.prod(shape))
            out[k] = flat[at : at + n].reshape(shape).astype(np.float32, copy=False)
            at += n
        return Model(out, self.place)


def start(counts: np.ndarray, seed: int = 11) -> Model:
    """A model whose output is the smoothed unigram distribution of ``counts``."""
    rng = np.random.default_rng(seed)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(IDS, dtype=np.int64)
    place[order] = np.arange(IDS)
    p = (counts + 0.5) / (counts.sum() + 0.5 * IDS)
    by_place = p[order].reshape(CLASSES, WIDE)
    scale = {"emb": 0.3, "wq": 0.25, "wk": 0.25, "wv": 0.25, "w1": 0.25, "w2": 0.25, "wc": 0.05, "wi": 0.05}
    params = {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
    params["emb"][PAD] = 0
    params["bc"] = np.log(by_place.sum(axis=1)).astype(np.float32)
    params["bi"] = np.log(by_place / by_place.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(params, place)


def blocks(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of inputs, targets of their blocks, sequence of each window).

    The input before an id is the id before it, END before the first.
    """
    inputs, targets, owner = [], [], []
    for k, ids in enumerate(sequences):
        n = len(ids)
        m = -(-n // STRIDE)
        row = np.full(CONTEXT + m * STRIDE, PAD, dtype=np.int16)
        row[CONTEXT] = END
        row[CONTEXT + 1 : CONTEXT + n] = ids[:-1]
        aim = np.full(m * STRIDE, -1, dtype=np.int16)
        aim[:n] = ids
        inputs.append(np.lib.stride_tricks.sliding_window_view(row, WINDOW)[::STRIDE])
        targets.append(aim.reshape(m, STRIDE))
        owner.append(np.full(m, k))
    return np.concatenate(inputs), np.concatenate(targets), np.concatenate(owner)


def _places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class and number of each id; padding, -1, is in a class after the last."""
    place = np.append(place, IDS)
    return (place // WIDE).astype(np.uint8), place % WIDE


def _joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The products that attention needs: queries against ids' own rows, values as hidden units see them, and each id's share of the hidden layer."""
    return p["wq"] @ p["wk"].T / np.float32(np.sqrt(DIM)), p["wv"] @ p["w2"], p["emb"] @ p["w1"] + p["b1"]


def _sides(emb: np.ndarray) -> np.ndarray:
    """Each id as a key, without the last column, and as a value, without the first."""
    out = np.ones((IDS + 1, DIM + 2), np.float32)
    out[:, 0], out[PAD, 0] = 0, -1e4
    out[:, 1:-1] = emb
    return out


def _far(near: np.ndarray) -> np.ndarray:
    return (near[_distance] - 1e4 * (1 - _causal)).astype(np.float32)


def _tanh(x: np.ndarray, out: np.ndarray) -> None:
    """tanh of half of x, of which nothing is kept; faster than numpy's."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    np.add(x, 1, out=out)


class _Room(dict):
    """Arrays by name that are used again for each batch."""

    def __call__(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        size = prod(shape)
        if name not in self or len(self[name]) < size:
            self[name] = np.empty(size, kind)
        return self[name][:size].reshape(shape)


def _tables(model: Model) -> dict[str, np.ndarray]:
    p = model.params
    q = p["emb"] @ p["wq"] / np.float32(np.sqrt(DIM))
    return {"q": q, "k": p["emb"] @ p["wk"], "v": p["emb"] @ p["wv"], "w": p["emb"] @ p["w1"] + p["b1"]}


class Scorer:
    """Scores with the sums of the model folded into its products.

    A column of ones carries each bias and each sum through a matrix product;
    a key column and the added distances make what is masked vanish in exp().
    """

    def __init__(self, model: Model):
        self.place = model.place
        p, t = model.params, _tables(model)
        ones = np.ones((IDS + 1, 1), np.float32)
        padding = np.zeros((IDS + 1, 1), np.float32)
        padding[PAD] = -1e4
        self.q, self.k, self.v = np.hstack((t["q"], ones)), np.hstack((t["k"], padding)), np.hstack((t["v"], ones))
        self.w, self.w2 = 2 * t["w"], 2 * p["w2"]
        self.far = (p["near"][_distance] - 1e4 * (1 - _causal)).astype(np.float32)
        self.class_ones, self.wide_ones = np.ones(CLASSES, np.float32), np.ones(WIDE, np.float32)
        self.wc = np.vstack((p["wc"], p["bc"]))
        self.wi = np.concatenate((p["wi"], p["bi"][:, None, :]), axis=1)

        rows = BATCH * STRIDE
        shapes = {"q": (BATCH, STRIDE, DIM + 1), "k": (BATCH, WINDOW, DIM + 1), "v": (BATCH, WINDOW, DIM + 1), "weight": (BATCH, STRIDE, WINDOW), "mixed": (BATCH, STRIDE, DIM + 1),
                  "mean": (rows, DIM), "own": (rows, HIDDEN), "inner": (rows, HIDDEN), "h": (rows, HIDDEN + 1), "ordered": (rows, HIDDEN + 1), "ec": (rows, CLASSES), "ei": (rows, WIDE)}
        self.room = {k: np.ones(v, np.float32) for k, v in shapes.items()}  # used again for each batch

    def block_scores(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of the ids of each block."""
        return np.concatenate([self._batch(windows[a : a + BATCH].astype(np.int64), targets[a : a + BATCH].astype(np.int64)) for a in range(0, len(windows), BATCH)] or [np.empty(0)])

    def _batch(self, window: np.ndarray, aim: np.ndarray) -> np.ndarray:
        size = len(window)
        n = size * STRIDE
        q, k, v, weight, mixed = (self.room[x][:size] for x in ("q", "k", "v", "weight", "mixed"))
        mean, own, inner, h, ordered, ec, ei = (self.room[x][:n] for x in ("mean", "own", "inner", "h", "ordered", "ec", "ei"))
        block = np.ascontiguousarray(window[:, CONTEXT:])
        for table, at, out in ((self.q, block, q), (self.k, window, k), (self.v, window, v), (self.w, block.ravel(), own)):
            np.take(table, at, axis=0, out=out, mode="clip")
        np.matmul(q, k.transpose(0, 2, 1), out=weight)
        weight += self.far
        np.exp(weight, out=weight)
        np.matmul(weight, v, out=mixed)
        flat = mixed.reshape(n, DIM + 1)
        flat[:, DIM] += 1e-30  # padding attends to nothing
        np.divide(flat[:, :DIM], flat[:, DIM:], out=mean)
        np.matmul(mean, self.w2, out=inner)
        inner += own
        _tanh(inner, h[:, :HIDDEN])
        np.matmul(h, self.wc, out=ec)
        real = (aim >= 0).ravel()
        place = self.place[np.where(real, aim.ravel(), 0)]
        klass = place // WIDE
        rows = np.arange(n)
        log_p = ec[rows, klass].astype(np.float64)
        np.exp(ec, out=ec)
        log_p -= np.log(ec @ self.class_ones)
        order = np.argsort(klass.astype(np.uint8), kind="stable")
        counts = np.bincount(klass, minlength=CLASSES)
        stops = np.cumsum(counts)
        np.take(h, order, axis=0, out=ordered, mode="clip")
        for c in np.flatnonzero(counts).tolist():
            s = slice(stops[c] - counts[c], stops[c])
            np.dot(ordered[s], self.wi[c], out=ei[s])
        chosen = ei[rows, (place - klass * WIDE)[order]]
        np.exp(ei, out=ei)
        log_p[order] += chosen - np.log(ei @ self.wide_ones)
        return (log_p * real).reshape(size, STRIDE).sum(axis=1)

    def scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each sequence; every sequence has an id at least."""
        if not sequences:
            return np.zeros(0)
        windows, targets, owner = blocks(sequences)
        return np.bincount(owner, weights=self.block_scores(windows, targets), minlength=len(sequences)) / np.log(10)


class Trainer:
    """Adam on blocks of windows.

    Queries and keys meet as one product of their matrices between the rows of
    ids, values and the hidden layer's weights as another, so a position's
    gradient in its id's row comes without a detour by key and value, and the
    matrices' own gradients from those of the products. Positions are ordered
    by the class of their id once; padding comes last there and is left out of
    the outputs. The exponentials of the attention are never divided by their
    sums: the sums go into the smaller factors of each product.
    """

    def __init__(self, model: Model, rate: float = RATE):
        self.flat = model.flat().astype(np.float32)  # the parameters below are views of it
        self.model, self.rate, self.steps = model.with_flat(self.flat), rate, 0
        self.mean, self.square, self.slope = np.zeros_like(self.flat), np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.g = model.with_flat(self.slope).params  # views too
        self.klass, self.number = _places(model.place)
        self.own, self.sides, self.room = np.ones((IDS + 1, 1 + DIM + HIDDEN), np.float32), _sides(model.params["emb"]), _Room()

    def step(self, window: np.ndarray, aim: np.ndarray) -> float:
        """One update; returns the mean loss of the ids, in nats."""
        loss = self.slopes(window, aim)
        self._update()
        return loss

    def slopes(self, window: np.ndarray, aim: np.ndarray) -> float:
        """Sets the gradients of the mean loss, which it returns."""
        window, aim = window.astype(np.intp), aim.ravel()
        size, n = len(window), len(aim)
        p, g, room = self.model.params, self.g, self.room
        joined, shown, own = _joined(p)
        e = p["emb"]
        np.matmul(e, joined, out=self.own[:, 1 : DIM + 1])
        np.multiply(own, 2, out=self.own[:, DIM + 1 :])
        self.sides[:, 1:-1] = e
        own, sides = room("own", size, STRIDE, 1 + DIM + HIDDEN), room("sides", size, WINDOW, DIM + 2)
        np.take(self.own, window[:, CONTEXT:], axis=0, out=own, mode="clip")
        np.take(self.sides, window, axis=0, out=sides, mode="clip")
        # Weights with what comes to their sums, and slopes with queries, lie side by side for one product at the end.
        both, right = room("both", size, 2 * STRIDE, WINDOW), room("right", size, 2 * STRIDE, DIM)
        weight, weight_slope = both[:, :STRIDE], both[:, STRIDE:]
        right[:, STRIDE:] = own[:, :, 1 : DIM + 1]
        np.matmul(own[:, :, : DIM + 1], sides[:, :, :-1].transpose(0, 2, 1), out=weight)
        weight += _far(p["near"])
        np.exp(weight, out=weight)
        mixed, mean = room("mixed", size, STRIDE, DIM + 1), room("mean", size, STRIDE, DIM)
        np.matmul(weight, sides[:, :, 1:], out=mixed)
        share = 1 / (mixed[:, :, DIM:] + np.float32(1e-30))
        np.multiply(mixed[:, :, :DIM], share, out=mean)
        mean = mean.reshape(n, DIM)
        hidden, h = room("hidden", n, HIDDEN), room("h", n, HIDDEN + 1)
        np.matmul(mean, 2 * shown, out=hidden)
        hidden += own.reshape(n, -1)[:, DIM + 1 :]
        _tanh(hidden, h[:, :HIDDEN])
        h[:, HIDDEN] = 1

        klass = self.klass[aim]
        order = np.argsort(klass, kind="stable")
        counts = np.bincount(klass, minlength=CLASSES + 1)
        real, stops = n - int(counts[CLASSES]), np.cumsum(counts)
        order, rows = order[:real], np.arange(real)
        place = np.full(n, real)
        place[order] = rows
        klass, number = klass[order], self.number[aim[order]]
        ordered, outer, inner = room("ordered", real, HIDDEN + 1), room("outer", real, CLASSES), room("inner", real, WIDE)
        np.take(h, order, axis=0, out=ordered, mode="clip")
        h = ordered
        np.matmul(h, np.vstack((p["wc"], p["bc"])), out=outer)
        np.exp(outer, out=outer)
        within = np.concatenate((p["wi"], p["bi"][:, None, :]), axis=1)
        parts = [(c, slice(stops[c] - counts[c], stops[c])) for c in np.flatnonzero(counts[:CLASSES]).tolist()]
        for c, s in parts:
            np.dot(h[s], within[c], out=inner[s])
        np.exp(inner, out=inner)
        loss = 0.0
        for x, hit in ((outer, klass), (inner, number)):  # turns into probabilities less the truth
            total = x @ np.ones(x.shape[1], np.float32)
            loss -= float(np.log(x[rows, hit] / total).sum())
            x *= (1 / (total * np.float32(real)))[:, None]
            x[rows, hit] -= np.float32(1 / real)

        dhs, more = room("dh", real + 1, HIDDEN), room("more", real, HIDDEN)
        dh, dhs[real] = dhs[:real], 0  # the last for padding
        slope = h.T @ outer
        g["wc"][:], g["bc"][:] = slope[:HIDDEN], slope[HIDDEN]
        np.matmul(outer, p["wc"].T, out=dh)
        g["wi"][:], g["bi"][:] = 0, 0
        for c, s in parts:
            slope = h[s].T @ inner[s]
            g["wi"][c], g["bi"][c] = slope[:HIDDEN], slope[HIDDEN]
            np.dot(inner[s], p["wi"][c].T, out=more[s])
        dh += more
        np.multiply(h[:, :HIDDEN], h[:, :HIDDEN], out=more)
        more *= dh
        dh -= more
        dhidden = room("dhidden", n, HIDDEN)
        np.take(dhs, place, axis=0, out=dhidden, mode="clip")
        down = room("down", size, STRIDE, DIM + HIDDEN)
        down[:, :, DIM:] = dhidden.reshape(size, STRIDE, HIDDEN)
        dshown = mean.T @ dhidden
        g["b1"][:] = np.ones(n, np.float32) @ dhidden
        g["wv"][:], g["w2"][:] = dshown @ p["w2"].T, p["wv"].T @ dshown

        dmean, left = room("dmean", n, DIM), room("left", size, STRIDE, DIM + 1)
        np.matmul(dhidden, shown.T, out=dmean)
        np.multiply(dmean.reshape(size, STRIDE, DIM), share, out=left[:, :, :DIM])
        left[:, :, DIM] = np.einsum("ij,ij->i", dmean, mean).reshape(size, STRIDE) * -share[:, :, 0]
        right[:, :STRIDE] = left[:, :, :DIM]
        np.matmul(left, sides[:, :, 1:].transpose(0, 2, 1), out=weight_slope)
        weight_slope *= weight
        np.matmul(weight_slope, sides[:, :, 1:-1], out=down[:, :, :DIM])
        around, block = room("around", size, WINDOW, DIM), room("block", size, STRIDE, DIM)
        np.matmul(both.transpose(0, 2, 1), right, out=around)
        g["near"][:] = np.bincount(_distance.ravel(), weights=weight_slope.sum(axis=0).ravel(), minlength=WINDOW)

        block[:] = sides[:, CONTEXT:, 1:-1]
        down = down.reshape(n, DIM + HIDDEN)
        slope = block.reshape(n, DIM).T @ down
        g["w1"][:], slope = slope[:, DIM:], slope[:, :DIM] / np.float32(np.sqrt(DIM))
        g["wq"][:], g["wk"][:] = slope @ p["wk"], slope.T @ p["wq"]
        np.matmul(down, np.hstack((joined, p["w1"])).T, out=block.reshape(n, DIM))
        around[:, CONTEXT:] += block
        places = np.add((window * DIM)[:, :, None], np.arange(DIM), out=room("places", size, WINDOW, DIM, kind=np.intp))
        g["emb"][:] = np.bincount(places.ravel(), weights=around.ravel(), minlength=(IDS + 1) * DIM).reshape(IDS + 1, DIM)
        g["emb"][PAD] = 0
        return loss / real

    def _update(self) -> None:
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 20) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        slope = self.slope
        self.mean *= np.float32(0.9)
        self.mean += np.float32(0.1) * slope
        slope *= slope
        self.square *= np.float32(0.99)
        self.square += np.float32(0.01) * slope
        np.sqrt(self.square, out=slope)
        slope += np.float32(1e-8)
        np.divide(self.mean, slope, out=slope)
        slope *= np.float32(rate)
        self.flat -= slope
