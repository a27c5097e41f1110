"""A gated recurrent language model in numpy: training windows and scoring.

Symbols are numbered by class, so that a class is a range of symbols. The output
is class-factored: P(symbol) = P(class | state) * P(symbol | class, state).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATE, LANES, RATE, CLASSES = 16, 256, 0.1, 64
#: Steps of one backward pass, and of one piece of scoring.
WINDOW, STRETCH = 32, 64


@dataclass
class Shape:
    """Symbols and where each class begins (with the end)."""

    symbols: int
    starts: np.ndarray

    def __post_init__(self):
        #: The class of each symbol.
        self.class_of = np.repeat(np.arange(len(self.starts) - 1, dtype=np.uint8), np.diff(self.starts))

    def sizes(self) -> dict[str, tuple[int, ...]]:
        m, c = self.symbols, len(self.starts) - 1
        return {"gates": (m, 3 * STATE), "recur": (STATE, 3 * STATE), "class_w": (c, STATE), "class_b": (c,), "word_w": (m, STATE), "word_b": (m,)}


def class_starts(counts: np.ndarray) -> np.ndarray:
    """Ranges of symbols (sorted by falling count) of about equal sums of root counts."""
    mass = np.cumsum(np.sqrt(counts + 1.0))
    classes = min(CLASSES, len(counts))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], np.minimum(cuts, len(counts)), [len(counts)]]))


def initial(shape: Shape, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the biases are the logarithms of the counted shares."""
    rng, counts = np.random.default_rng(7), counts + 0.1
    p = {k: (rng.standard_normal(v) * 0.1).astype(np.float32) for k, v in shape.sizes().items()}
    mass = np.add.reduceat(counts, shape.starts[:-1])
    p["class_b"] = np.log(mass / mass.sum()).astype(np.float32)
    p["word_b"] = np.log(counts / np.repeat(mass, np.diff(shape.starts))).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()]).astype(np.float32)


def unflat(v: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.sizes().items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).copy()
        at += n
    return out


class Lanes:
    """Texts laid end to end in lanes, longest first into the shortest lane; state is reset where a text begins.

    The lanes lie one behind another in flat arrays, so that memory grows with the
    tokens and not with the longest text; a window is gathered when it is needed.
    """

    def __init__(self, texts: list[np.ndarray], first: int, lanes: int = LANES):
        import heapq

        lanes = max(1, min(lanes, len(texts)))
        heap, members = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for k in sorted(range(len(texts)), key=lambda k: (-len(texts[k]), k)):
            n, lane = heapq.heappop(heap)
            members[lane].append(k)
            heapq.heappush(heap, (n + len(texts[k]), lane))
        # Longest lane first: the lanes still in use at a step are the leading ones.
        heap.sort(key=lambda x: (-x[0], x[1]))
        self.lengths = np.array([n for n, _ in heap], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.steps = int(self.lengths[0])
        order = [k for _, lane in heap for k in members[lane] if len(texts[k])]
        sizes = np.array([len(texts[k]) for k in order], np.int64)
        self.target = np.concatenate([np.asarray(texts[k], np.int32) for k in order] or [np.zeros(0, np.int32)])
        self.text = np.repeat(np.array(order, np.int32), sizes)
        heads = np.cumsum(sizes) - sizes
        self.source = np.concatenate([self.target[:1], self.target[:-1]])
        self.source[heads] = first
        self.keep = np.ones(len(self.target), np.float32)
        self.keep[heads] = 0

    def windows(self, size: int):
        """(begin, steps, lanes in use) of consecutive windows."""
        for t0 in range(0, self.steps, size):
            yield t0, min(size, self.steps - t0), int(np.searchsorted(-self.lengths, -t0, side="left"))

    def window(self, t0: int, steps: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(target, source, keep, text), each [steps, b]; the target is -1 past the end of a lane."""
        t = np.arange(t0, t0 + steps)[:, None]
        inside = t < self.lengths[:b]
        at = np.where(inside, self.offsets[:b] + t, 0)
        return np.where(inside, self.target[at], -1), np.where(inside, self.source[at], 0), np.where(inside, self.keep[at], np.float32(1)), self.text[at]


def _forward(p: dict, source: np.ndarray, keep: np.ndarray, h: np.ndarray, backward: bool = True) -> tuple[dict, np.ndarray]:
    """The states of each step (h), with ``backward`` also what the backward pass needs of it, and the last state."""
    (b, s), steps = h.shape, len(source)
    slots = steps if backward else 1
    kept = {k: np.empty((slots, b, s), np.float32) for k in ("prev", "n", "un")} | {"h": np.empty((steps, b, s), np.float32)}
    zr = np.empty((slots, b, 2 * s), np.float32)
    given, keep, rec = p["gates"][source], keep[:, :, None], np.empty((b, 3 * s), np.float32)
    for t in range(steps):
        k = t if backward else 0
        h = np.multiply(h, keep[t], out=kept["prev"][k])
        np.matmul(h, p["recur"], out=rec)
        gate = np.add(given[t, :, : 2 * s], rec[:, : 2 * s], out=zr[k])
        np.exp(np.negative(gate, out=gate), out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        if backward:
            kept["un"][k] = rec[:, 2 * s :]
        n = np.multiply(gate[:, s:], rec[:, 2 * s :], out=kept["n"][k])
        n += given[t, :, 2 * s :]
        np.tanh(n, out=n)
        now = np.subtract(h, n, out=kept["h"][t])
        now *= gate[:, :s]
        now += n
        h = now
    return kept | {"z": zr[:, :, :s], "r": zr[:, :, s:]}, h


_ONES = np.ones(4096, np.float32)


def _reach(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What no logit of each output passes: states lie within -1 and 1."""
    return np.abs(w).sum(axis=1) + np.abs(b)


def _exponentials(logits: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row (in place, up to a factor a row), their sums; the logarithm of the sums is of the rows as given.

    Where ``reach``, a bound of the logits, is small they need not be searched for large ones.
    """
    ones = _ONES[: logits.shape[1]] if logits.shape[1] <= len(_ONES) else np.ones(logits.shape[1], np.float32)
    if reach < 59 or np.abs(logits).max(initial=0) < 60:
        np.exp(logits, out=logits)
        total = logits @ ones
        return total, np.log(total)
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    np.exp(logits, out=logits)
    total = logits @ ones
    return total, top[:, 0] + np.log(total)


def _output(p: dict, shape: Shape, state: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-likelihood of each target; with ``grads``, also the gradient of the negative sum in the state."""
    order = np.argsort(shape.class_of[target], kind="stable")
    x, target = state[order], target[order]
    cls = shape.class_of[target]
    rows = np.arange(len(target))
    logits = x @ p["class_w"].T
    logits += p["class_b"]
    hit = logits[rows, cls]
    total, log_total = _exponentials(logits, _reach(p["class_w"], p["class_b"]).max())
    loglik = hit - log_total
    back = None
    if grads is not None:
        logits /= total[:, None]
        logits[rows, cls] -= 1
        back = logits @ p["class_w"]
        grads["class_w"], grads["class_b"] = logits.T @ x, logits.sum(axis=0)
        grads["word_w"], grads["word_b"] = np.zeros_like(p["word_w"]), np.zeros_like(p["word_b"])
    bounds = np.searchsorted(cls, np.arange(len(shape.starts)))
    reach = np.maximum.reduceat(_reach(p["word_w"], p["word_b"]), shape.starts[:-1])
    for c in np.flatnonzero(np.diff(bounds)).tolist():
        i, j, a, b = int(bounds[c]), int(bounds[c + 1]), int(shape.starts[c]), int(shape.starts[c + 1])
        if b - a == 1:  # the only symbol of its class
            continue
        w, own, hit, k = p["word_w"][a:b], x[i:j], target[i:j] - a, rows[: j - i]
        logits = own @ w.T
        logits += p["word_b"][a:b]
        loglik[i:j] += logits[k, hit]
        total, log_total = _exponentials(logits, reach[c])
        loglik[i:j] -= log_total
        if grads is not None:
            logits /= total[:, None]
            logits[k, hit] -= 1
            back[i:j] += logits @ w
            np.matmul(logits.T, own, out=grads["word_w"][a:b])
            grads["word_b"][a:b] = logits.sum(axis=0)
    out = np.empty_like(loglik)
    out[order] = loglik
    if back is None:
        return out, None
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return out, unsorted


def gradients(p: dict, shape: Shape, lanes: Lanes, t0: int, steps: int, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """One window of truncated backpropagation: mean gradients of the dense weights, (symbols, gradients) of the gates, the last state."""
    b, s = h.shape
    target, source, keep, _ = lanes.window(t0, steps, b)
    f, last = _forward(p, source, keep, h)
    target, source, keep = target.ravel(), source.ravel(), keep[:, :, None]
    used = np.flatnonzero(target >= 0)
    grads: dict[str, np.ndarray] = {}
    back = np.zeros((steps * b, s), np.float32)
    back[used] = _output(p, shape, f["h"].reshape(-1, s)[used], target[used], grads)[1]
    back = back.reshape(steps, b, s)
    z, r, n, turned = np.ascontiguousarray(f["z"]), np.ascontiguousarray(f["r"]), f["n"], np.ascontiguousarray(p["recur"].T)
    off = 1 - z
    to_n, to_z, to_r = 1 - n * n, f["prev"] - n, np.multiply(f["un"], r, out=f["un"])
    to_n *= off
    to_z *= z
    to_z *= off
    to_r *= np.subtract(1, r, out=off)
    d_in, d_rec, dh = np.empty((steps, b, 3 * s), np.float32), np.empty((steps, b, 3 * s), np.float32), np.zeros((b, s), np.float32)
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        rec = d_rec[t]
        dn = np.multiply(dh, to_n[t], out=d_in[t, :, 2 * s :])
        np.multiply(dh, to_z[t], out=rec[:, :s])
        np.multiply(dn, to_r[t], out=rec[:, s : 2 * s])
        np.multiply(dn, r[t], out=rec[:, 2 * s :])
        dh *= z[t]
        dh += rec @ turned
        dh *= keep[t]
    d_in[:, :, : 2 * s] = d_rec[:, :, : 2 * s]
    grads["recur"] = f["prev"].reshape(-1, s).T @ d_rec.reshape(-1, 3 * s)
    scale = np.float32(1 / max(len(used), 1))
    for g in grads.values():
        g *= scale
    order = np.argsort(source.astype(np.uint16), kind="stable") if shape.symbols <= 1 << 16 else np.argsort(source, kind="stable")
    own = source[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return grads, own[heads], np.add.reduceat(d_in.reshape(-1, 3 * s)[order], heads, axis=0) * scale, last


def train(p: dict, shape: Shape, texts: list[np.ndarray], first: int, memory: dict) -> None:
    """One pass of truncated backpropagation over these texts, in place; ``memory`` keeps the squared gradients."""
    lanes = Lanes(texts, first)
    h = np.zeros((len(lanes.lengths), STATE), np.float32)
    for t0, steps, b in lanes.windows(WINDOW):
        grads, rows, gates, h = gradients(p, shape, lanes, t0, steps, h[:b])
        for k, g in grads.items():
            _step(p[k], memory[k], g)
        memory["gates"][rows] += gates * gates
        p["gates"][rows] -= RATE * gates / (np.sqrt(memory["gates"][rows]) + 1e-8)


def _step(p: np.ndarray, memory: np.ndarray, g: np.ndarray) -> None:
    memory += g * g
    p -= RATE * g / (np.sqrt(memory) + 1e-8)


def score(p: dict, shape: Shape, texts: list[np.ndarray], first: int) -> np.ndarray:
    """Natural log-likelihood of each whole text; the state is carried across windows."""
    total = np.zeros(len(texts))
    lanes = Lanes(texts, first)
    h = np.zeros((len(lanes.lengths), STATE), np.float32)
    for t0, steps, b in lanes.windows(STRETCH):
        target, source, keep, text = lanes.window(t0, steps, b)
        f, h = _forward(p, source, keep, h[:b], backward=False)
        target = target.ravel()
        used = np.flatnonzero(target >= 0)
        loglik, _ = _output(p, shape, f["h"].reshape(-1, STATE)[used], target[used], None)
        total += np.bincount(text.ravel()[used], loglik, len(texts))
    return total
