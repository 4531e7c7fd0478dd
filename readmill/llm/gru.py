"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Width of the state and of embeddings; words of a class with a softmax of its own.
WIDTH, CLASS_WORDS = 16, 256
#: Streams and steps of a training window; tokens' places that texts of uneven lengths may take when laid out.
STREAMS, STEPS, CELLS = 256, 16, 4_000_000


#: Logits between which float32 exponentials need no shift.
SAFE = 80.0


@dataclass
class Tokens:
    """A text as arrays: input row, class, and place in the class's softmax (-1: the class has none)."""

    row: np.ndarray
    cls: np.ndarray
    place: np.ndarray


def start(n_rows: int, class_logs: np.ndarray, word_logs: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that give the unigram model: biases are log shares, and what the state adds starts near zero."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "emb": small(n_rows, WIDTH) * 3, "w": small(WIDTH, 3 * WIDTH) * 3, "u": small(WIDTH, 3 * WIDTH), "b": np.zeros(3 * WIDTH, np.float32),
        "wc": small(WIDTH, len(class_logs)) * 0.1, "bc": class_logs.astype(np.float32), "ww": small(*word_logs.shape, WIDTH) * 0.1, "bw": word_logs.astype(np.float32),
    }


def states(x: np.ndarray, u: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, tuple]:
    """States before each token (steps, WIDTH, streams), the state after the last, and each step's gates, new values and
    what the state adds to these.  Streams are the last axis, so that every gate is one stretch of memory.

    x: what the inputs add (steps, 3 * WIDTH, streams), u: (3 * WIDTH, WIDTH); both with the gates' signs turned.
    """
    steps, d, n = len(x), WIDTH, x.shape[2]
    before = np.empty((steps + 1, d, n), u.dtype)
    before[0] = h
    gates, new, hu = (np.empty((steps if keep else 1, k * d, n), u.dtype) for k in (2, 1, 3))
    begins, stay = fresh.any(axis=1).tolist(), (~fresh).astype(u.dtype)
    zr, m, own = gates[0], new[0], hu[0]
    for t in range(steps):
        h, after, xt = before[t], before[t + 1], x[t]
        if begins[t]:
            h *= stay[t]
        if keep:
            zr, m, own = gates[t], new[t], hu[t]
        np.matmul(u, h, out=own)
        np.add(xt[: 2 * d], own[: 2 * d], out=zr)
        np.exp(zr, out=zr)
        np.add(zr, 1, out=zr)
        np.reciprocal(zr, out=zr)
        np.multiply(zr[d:], own[2 * d :], out=m)
        np.add(m, xt[2 * d :], out=m)
        np.tanh(m, out=m)
        np.subtract(h, m, out=after)
        np.multiply(after, zr[:d], out=after)
        np.add(after, m, out=after)
    return before[:steps], before[steps], (gates, new, hu[:, 2 * d :])


def turned(w: np.ndarray) -> np.ndarray:
    """Weights (or a bias) of gates and new values, with the gates' signs turned: a gate is then 1 / (1 + exp(x))."""
    return np.concatenate([-w[..., : 2 * WIDTH], w[..., 2 * WIDTH :]], axis=-1)


def window(p: dict[str, np.ndarray], row: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """States before each token (steps, streams, WIDTH), the state after the last, and what backpropagation needs.

    fresh marks tokens that begin a text: the state before them is zero.
    """
    emb = np.ascontiguousarray(p["emb"][row].transpose(0, 2, 1))
    x = np.matmul(turned(p["w"]).T, emb) + turned(p["b"])[:, None]
    before, h, kept = states(x, turned(p["u"]).T.copy(), fresh, h.T)
    return before.transpose(0, 2, 1), h.T, (emb, before, *kept)


def is_safe(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no state (its values are between -1 and 1) makes all logits of a softmax so low or one so high that their
    exponentials are lost; w: (..., words, WIDTH), b: (..., words)."""
    most = np.abs(w).sum(axis=-1)
    return ((b + most).max(axis=-1) < SAFE) & ((b - most).max(axis=-1) > -SAFE)


def exponentials(h: np.ndarray, w: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(h @ w.T), each row divided by a power of e where that is needed, and that power."""
    e, top = h @ w.T, 0.0
    if not safe:
        top = e.max(axis=1)
        e -= top[:, None]
    return np.exp(e, out=e), top


def with_ones(x: np.ndarray) -> np.ndarray:
    """Rows with a 1 behind, which takes the bias in."""
    out = np.ones((*x.shape[:-1], x.shape[-1] + 1), x.dtype)
    out[..., :-1] = x
    return out


def with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([w, b[..., None]], axis=-1)


def keys(p: dict[str, np.ndarray], cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each softmax word, by class, and behind those one for each class without words; sorted in linear time."""
    classes, words = p["bw"].shape
    kind = np.int16 if classes * words + p["bc"].size < 1 << 15 else np.int32
    return np.where(place >= 0, cls.astype(kind) * kind(words) + place.astype(kind), cls.astype(kind) + kind(classes * words))


def outputs(p: dict[str, np.ndarray], h: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Natural log probabilities of class and place, for rows of states."""
    (classes, words), key = p["bw"].shape, keys(p, cls, place)
    order = np.argsort(key, kind="stable")
    h, cls, key = with_ones(h.take(order, axis=0)), cls[order], key[order]
    w, c = with_bias(p["ww"], p["bw"]), with_bias(p["wc"].T, p["bc"])
    e, top = exponentials(h, c, is_safe(p["wc"].T, p["bc"]))
    logs = np.einsum("ij,ij->i", h, c.take(cls, axis=0)) - top - np.log(e.sum(axis=1))
    cuts, safe = np.searchsorted(key, np.arange(classes + 1) * words), is_safe(p["ww"], p["bw"])
    own = slice(cuts[-1])
    logs[own] += np.einsum("ij,ij->i", h[own], w.reshape(-1, WIDTH + 1).take(key[own], axis=0))
    for k in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[k], cuts[k + 1])
        e, top = exponentials(h[part], w[k], safe[k])
        logs[part] -= np.log(e.sum(axis=1)) + top
    out = np.empty_like(logs)
    out[order] = logs
    return out


def gradients(p: dict[str, np.ndarray], row: np.ndarray, fresh: np.ndarray, cls: np.ndarray, place: np.ndarray, used: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Slopes of the mean log loss over a window's used tokens, cut off at its beginning, and the state after it.

    A softmax's exponentials e are never scaled: their sums come with e @ [w, 1], and the slopes of w from the states scaled
    by these; what the word itself takes off is summed by word, as tokens are in the order of their words.
    """
    before, after, (emb, prev, gates, m, hn) = window(p, row, fresh, h)
    n, d, steps, streams = row.size, WIDTH, *row.shape
    (classes, words), key = p["bw"].shape, keys(p, cls.ravel(), place.ravel())
    order = np.argsort(key, kind="stable")
    order = order[used.ravel()[order]]
    x, c, key = with_ones(before.reshape(-1, d).take(order, axis=0)), cls.ravel()[order], key[order]
    wc, w, one = p["wc"].T, p["ww"], p["wc"].dtype.type(1 / n)
    e, _ = exponentials(x, with_bias(wc, p["bc"]), is_safe(wc, p["bc"]))
    to_h = e @ with_ones(wc)
    scale = one / to_h[:, d:]
    slopes_c, grad = e.T @ (x * scale), to_h[:, :d] * scale - wc.take(c, axis=0) * one
    cuts, safe = np.searchsorted(key, np.arange(classes + 1) * words), is_safe(w, p["bw"])
    slopes_w, biased, summed = np.zeros((classes, words, d + 1), w.dtype), with_bias(w, p["bw"]), with_ones(w)
    for k in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[k], cuts[k + 1])
        e, _ = exponentials(x[part], biased[k], safe[k])
        to_h = e @ summed[k]
        scale = one / to_h[:, d:]
        np.matmul(e.T, x[part] * scale, out=slopes_w[k])
        to_h *= scale
        grad[part] += to_h[:, :d]
    if len(key):
        own = slice(cuts[-1])
        grad[own] -= w.reshape(-1, d).take(key[own], axis=0) * one
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(x, first, axis=0) * one
        word = key[first]
        inner = word < classes * words
        slopes_w.reshape(-1, d + 1)[word[inner]] -= sums[inner]
        of_class = np.flatnonzero(np.diff(c[first], prepend=-1))
        np.subtract.at(slopes_c, c[first][of_class], np.add.reduceat(sums, of_class, axis=0))
    dh = np.zeros((n, d), grad.dtype)
    dh[order] = grad
    g = {"wc": slopes_c[:, :d].T, "bc": slopes_c[:, d], "ww": slopes_w[:, :, :d], "bw": slopes_w[:, :, d]}
    dh = np.ascontiguousarray(dh.reshape(steps, streams, d).transpose(0, 2, 1))
    # what a step gives to its gates and its new values, for one unit of slope of the state after it
    z, r = gates[:, :d], gates[:, d:]
    unit = np.empty((steps, 3, d, streams), dh.dtype)
    of_new = np.multiply(1 - z, 1 - m * m, out=unit[:, 2])
    np.multiply((prev - m) * z, 1 - z, out=unit[:, 0])
    np.multiply(of_new * hn * r, 1 - r, out=unit[:, 1])
    through = unit.copy()
    through[:, 2] *= r
    backs, back = np.empty_like(dh), np.zeros((d, streams), dh.dtype)
    begins, stay, dhu, u = fresh.any(axis=1), (~fresh).astype(dh.dtype), through.reshape(steps, 3 * d, streams), p["u"]
    for t in range(steps - 1, -1, -1):
        backs[t] = back
        through[t] *= back
        back = back * z[t]
        back += u @ dhu[t]
        back += dh[t]
        if begins[t]:
            back *= stay[t]
    unit *= backs[:, None]
    dx = unit.reshape(steps, 3 * d, streams)
    g["u"], g["w"] = np.matmul(prev, dhu.transpose(0, 2, 1)).sum(axis=0), np.matmul(emb, dx.transpose(0, 2, 1)).sum(axis=0)
    g["b"], to_emb = dx.sum(axis=(0, 2)), np.matmul(p["w"], dx).transpose(0, 2, 1).reshape(n, d)
    g["emb"] = np.zeros_like(p["emb"])
    row = row.ravel().astype(np.int16 if len(p["emb"]) < 1 << 15 else np.int32)
    order = np.argsort(row, kind="stable")
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    g["emb"][row[first]] = np.add.reduceat(to_emb.take(order, axis=0), first, axis=0)
    return g, after


def lanes(texts: list[Tokens], n: int) -> list[list[int]]:
    """Texts dealt over n lanes of about equal lengths, longest first."""
    import heapq

    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i].row)):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + len(texts[i].row), k))
    return out


def laid_out(texts: list[Tokens], dealt: list[list[int]], fill: int = 0) -> tuple[np.ndarray, ...]:
    """(row, cls, place, fresh) of lanes side by side, one a column; and the lanes' lengths."""
    sizes = np.array([sum(len(texts[i].row) for i in lane) for lane in dealt])
    shape = (int(sizes.max()), len(dealt))
    row, cls, place, fresh = np.zeros(shape, np.int32), np.full(shape, fill, np.int16), np.full(shape, -1, np.int16), np.zeros(shape, bool)
    for k, lane in enumerate(dealt):
        at = 0
        for i in lane:
            x = texts[i]
            stop = at + len(x.row)
            # the input that precedes a token is the token before it; a text's first token is predicted from nothing
            row[at:stop, k], cls[at:stop, k], place[at:stop, k] = x.row, x.cls, x.place
            fresh[at, k] = True
            at = stop
    return row, cls, place, fresh, sizes


def train(p: dict[str, np.ndarray], texts: list[Tokens], rate: float = 0.01) -> dict[str, np.ndarray]:
    """One pass of Adam over all tokens of texts, laid out as streams; windows carry the state but cut the slopes.

    Streams that have ended are dropped, and windows of the streams that are left get longer, to about the tokens of a full
    window but not to where half of them have ended.  Slopes of windows are summed until they cover half of a full window's
    tokens, so that the few streams left at the end don't make steps of their own.
    """
    if not texts:
        return p
    longest, total = max(len(x.row) for x in texts), sum(len(x.row) for x in texts)
    dealt = lanes(texts, max(1, min(STREAMS, len(texts), max(total, CELLS) // longest)))
    row, cls, place, fresh, sizes = laid_out(texts, dealt)
    order = np.argsort(-sizes, kind="stable")  # streams that still have text come first
    row, cls, place, fresh, sizes = row[:, order], cls[:, order], place[:, order], fresh[:, order], sizes[order]
    h = np.zeros((row.shape[1], WIDTH), np.float32)
    # all parameters are one array, and each has its view of it
    flat = np.concatenate([x.ravel() for x in p.values()])
    cuts = np.cumsum([x.size for x in p.values()])[:-1]
    p = {k: part.reshape(x.shape) for (k, x), part in zip(p.items(), np.split(flat, cuts), strict=True)}
    m, v, slopes = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    own = {k: part.reshape(x.shape) for (k, x), part in zip(p.items(), np.split(slopes, cuts), strict=True)}
    tokens = i = at = 0
    while at < sizes[0]:
        live = int((sizes > at).sum())
        steps = max(STEPS, min(STEPS * len(sizes) // live, int(sizes[live // 2]) - at))
        part = slice(at, at + steps), slice(live)
        used = np.arange(at, at + len(row[part]))[:, None] < sizes[:live]
        g, h = gradients(p, row[part], fresh[part], cls[part], place[part], used, h[:live])
        for k, x in g.items():
            if tokens:
                own[k] += x * np.float32(used.size)
            else:
                np.multiply(x, np.float32(used.size), out=own[k])
        tokens, at = tokens + int(used.sum()), at + steps
        if 2 * tokens < len(sizes) * STEPS and at < sizes[0]:
            continue
        i += 1
        slopes /= np.float32(tokens)
        m += np.float32(0.1) * (slopes - m)
        slopes *= slopes
        slopes -= v
        slopes *= np.float32(0.01)
        v += slopes
        step = np.sqrt(np.divide(v, np.float32(1 - 0.99**i), out=slopes), out=slopes)
        step += np.float32(1e-6)
        np.divide(m, step, out=step)
        step *= np.float32(rate / (1 - 0.9**i))
        flat -= step
        tokens = 0
    return p


def log_probabilities(p: dict[str, np.ndarray], texts: list[Tokens], most: int = 256, steps: int = 32) -> np.ndarray:
    """Natural log probability of each whole text's classes and places; the state is carried over all its windows."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    longest, total = max(len(x.row) for x in texts), sum(len(x.row) for x in texts)
    dealt = lanes(texts, max(1, min(most, len(texts), total // longest)))
    row, cls, place, fresh, sizes = laid_out(texts, dealt)
    order = np.argsort(-sizes, kind="stable")  # lanes that still have text come first
    row, cls, place, fresh, sizes = row[:, order], cls[:, order], place[:, order], fresh[:, order], sizes[order]
    dealt = [dealt[k] for k in order]
    number = np.zeros(row.shape, np.int32)
    for k, lane in enumerate(dealt):
        lens = [len(texts[i].row) for i in lane]
        number[: sum(lens), k] = np.repeat(lane, lens)
    inputs, u = (p["emb"] @ turned(p["w"]) + turned(p["b"])).astype(np.float32), turned(p["u"]).T.copy()
    h, at = np.zeros((WIDTH, len(dealt)), np.float32), 0
    while at < len(row):
        live = int((sizes > at).sum())
        length = max(steps, min(steps * len(sizes) // live, int(sizes[live // 2]) - at))
        part = slice(at, at + length)
        x = np.ascontiguousarray(inputs[row[part, :live]].transpose(0, 2, 1))
        before, h, _ = states(x, u, fresh[part, :live], h[:, :live], keep=False)
        c, w = cls[part, :live].ravel(), place[part, :live].ravel()
        used = np.arange(at, at + len(x))[:, None] < sizes[None, :live]
        logs = outputs(p, before.transpose(0, 2, 1).reshape(-1, WIDTH), c, w)
        out += np.bincount(number[part, :live].ravel(), np.where(used.ravel(), logs, 0), len(texts))
        at += length
    return out
