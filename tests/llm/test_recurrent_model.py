"""The recurrent model against a plain forward pass and numeric gradients."""

import math

import numpy as np
import pytest

from glyphflow.llm import gru_model as g

TEXTS = [np.array(x, np.int32) for x in ([0, 1, 2, 5, 3], [4, 0], [2] * 20, [6, 5, 4, 3, 2, 1, 0], [1])]


def model():
    counts = np.array([9.0, 5, 4, 2, 2, 1, 1])
    shape = g.Shape(7, np.array([0, 1, 4, 7]))
    p = g.initial(shape, counts)
    rng = np.random.default_rng(3)
    return shape, {k: (v + 0.5 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in p.items()}


def plain_score(p, shape, text, first):
    """One symbol at a time, in double precision."""
    p = {k: v.astype(float) for k, v in p.items()}
    h, total, before, s = np.zeros(g.STATE), 0.0, first, g.STATE
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for symbol in text.tolist():
        given, rec = p["gates"][before], h @ p["recur"]
        z, r = sigmoid(given[:s] + rec[:s]), sigmoid(given[s : 2 * s] + rec[s : 2 * s])
        n = np.tanh(given[2 * s :] + r * rec[2 * s :])
        h = (1 - z) * n + z * h
        c = int(np.searchsorted(shape.starts, symbol, side="right")) - 1
        a, b = shape.starts[c], shape.starts[c + 1]
        classes, words = p["class_w"] @ h + p["class_b"], p["word_w"][a:b] @ h + p["word_b"][a:b]
        total += classes[c] - math.log(np.exp(classes).sum()) + words[symbol - a] - math.log(np.exp(words).sum())
        before = symbol
    return total


def test_scores_equal_a_plain_forward_pass():
    shape, p = model()
    assert g.score(p, shape, TEXTS, 2) == pytest.approx([plain_score(p, shape, t, 2) for t in TEXTS], rel=1e-4)
    p["class_b"][1] += 200  # beyond what exponentials of single precision hold
    assert g.score(p, shape, TEXTS, 2) == pytest.approx([plain_score(p, shape, t, 2) for t in TEXTS], rel=1e-4)


def test_gradients_equal_differences():
    shape, p = model()
    lanes = g.Lanes(TEXTS, 2, lanes=3)
    steps, used = lanes.steps, sum(map(len, TEXTS))
    h = np.zeros((len(lanes.lengths), g.STATE), np.float32)
    # One window, all lanes: the lengths differ, so short lanes end early.
    grads, rows, gates, _ = g.gradients(p, shape, lanes, 0, steps, h)
    full = dict(grads, gates=np.zeros_like(p["gates"]))
    full["gates"][rows] = gates
    loss = lambda: -sum(plain_score(p, shape, t, 2) for t in TEXTS) / used
    rng = np.random.default_rng(8)
    for name, own in full.items():
        for at in rng.choice(own.size, min(own.size, 12), replace=False):
            at, kept = np.unravel_index(at, own.shape), 0.0
            kept, p[name] = p[name][at], p[name].astype(float)
            p[name][at] = kept + 1e-4
            up = loss()
            p[name][at] = kept - 1e-4
            down = loss()
            p[name][at] = kept
            p[name] = p[name].astype(np.float32)
            assert own[at] == pytest.approx((up - down) / 2e-4, rel=2e-3, abs=5e-5), (name, at)


def test_state_is_carried_across_windows(monkeypatch):
    shape, p = model()
    whole = g.score(p, shape, TEXTS, 2)
    monkeypatch.setattr(g, "STRETCH", 3)
    assert g.score(p, shape, TEXTS, 2) == pytest.approx(whole, rel=1e-5)


def test_memory_of_lanes_grows_with_tokens_not_with_the_longest_text():
    """One text of half a million words beside two thousand of 300."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (500_000, *[300] * 2000)]
    total = sum(map(len, texts))
    tracemalloc.start()
    lanes = g.Lanes(texts, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * total  # laid as a rectangle it would be 500 000 x 256 x 16 bytes
    again = [np.zeros(len(t), np.int32) for t in texts]
    filled = np.zeros(len(texts), np.int64)
    for t0, steps, b in lanes.windows(50_000):
        target, source, keep, text = lanes.window(t0, steps, b)
        for lane in range(b):
            for k in np.unique(text[target[:, lane] >= 0, lane]).tolist():
                own = (text[:, lane] == k) & (target[:, lane] >= 0)
                n = int(own.sum())
                again[k][filled[k] : filled[k] + n] = target[own, lane]
                assert (keep[own, lane][0] == 0) == (filled[k] == 0) and (keep[own, lane][1:] == 1).all()
                filled[k] += n
    assert all((a == b).all() for a, b in zip(again, texts, strict=True))


def test_a_very_long_text_is_scored_whole():
    shape, p = model()
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (20_000, 3, 50, 1)]
    assert g.score(p, shape, texts, 2) == pytest.approx([plain_score(p, shape, t, 2) for t in texts], rel=1e-4)
