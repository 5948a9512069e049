"""A bidirectional gated recurrent network with attention pooling, in numpy: forward pass, gradients and training.

Every word has two inputs: the vector of its row in a vocabulary (zero for a word that isn't there) and the tanh of the mean vector of its character n-grams, taken from hashed rows. Both are
projected to the gates once per distinct word. One network reads a window of words onwards, one backwards; a weight per place comes from both states, and the weighted sum of the states
gives the window's logit.

Arrays of both directions lie side by side: the first axis is 0 for onwards, 1 for backwards. Step t of the backwards network reads place length - 1 - t.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Rows of n-gram vectors; sizes of n-grams in bytes.
GRAM_ROWS, SIZES = 1 << 16, (3, 4, 5)
WORD_DIM, GRAM_DIM, HIDDEN = 12, 12, 16


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all n-grams of all words in turn, how many each word has). A word is read between two marks, so even a letter has one."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    values = np.ndarray((int(lengths.sum()),), "<u8", data, strides=(1,))
    left = np.repeat(ends, lengths) - np.arange(len(values))  # bytes up to the word's end
    found, owner = [], np.repeat(np.arange(len(raw)), lengths)
    for size in SIZES:
        at = np.flatnonzero(left >= size)
        h = ((values[at] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        found.append((owner[at], (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)))
    owners, rows = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(raw))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, words: list[str], seed: int = 1, dtype=np.float32) -> "Network":
        rng, d = np.random.default_rng(seed), WORD_DIM + GRAM_DIM
        draw = {"words": (0.1, len(words) + 1, WORD_DIM), "grams": (0.3, GRAM_ROWS, GRAM_DIM), "zr_in": (d ** -0.5, 2, d, 2 * HIDDEN), "n_in": (d ** -0.5, 2, d, HIDDEN),
                "zr": (HIDDEN ** -0.5, 2, HIDDEN, 2 * HIDDEN), "n": (HIDDEN ** -0.5, 2, HIDDEN, HIDDEN), "heads": (HIDDEN ** -0.5, 2, HIDDEN, 2)}
        p = {k: (rng.standard_normal(shape) * scale).astype(dtype) for k, (scale, *shape) in draw.items()}
        p["words"][0] = 0  # words outside the vocabulary
        p |= {"zr_bias": np.zeros((2, 1, 2 * HIDDEN), dtype), "n_bias": np.zeros((2, 1, HIDDEN), dtype), "q_bias": np.zeros((2, 1, HIDDEN), dtype), "bias": np.zeros(1, dtype)}
        return cls({w: k + 1 for k, w in enumerate(words)}, p)

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))

    def inputs(self, rows: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Word and n-gram vectors of words, side by side."""
        means = np.add.reduceat(self.p["grams"][grams], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(self.p["grams"].dtype) if len(counts) else np.zeros((0, GRAM_DIM), np.float32)
        return np.concatenate([self.p["words"][rows], np.tanh(means)], 1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What words add to the gates z, r and to the candidate, for both directions."""
        return x @ self.p["zr_in"] + self.p["zr_bias"], x @ self.p["n_in"] + self.p["n_bias"]


def reversed_places(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Place that each step reads backwards; steps beyond a window's length stay where they are."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def pooled(heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, weights, values) from ``heads`` (steps, direction, window, 2): attention score and value of each state."""
    back = reversed_places(lengths, len(heads))
    both = heads[:, 0] + np.take_along_axis(heads[:, 1], back[:, :, None], 0)
    score, value = both[:, :, 0], both[:, :, 1]
    score = np.where(np.arange(len(heads))[:, None] < lengths, score, -np.inf)
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    return (weight * value).sum(0), weight, value


def logits(network: Network, zr_table: np.ndarray, n_table: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logit of each window. ``words``: (steps, windows) rows of the tables, which hold ``gates`` of words; ``lengths``: words of each window, at least one."""
    p, steps = network.p, len(words)
    back = np.take_along_axis(words, reversed_places(lengths, steps), 0)
    h = np.zeros((2, words.shape[1], HIDDEN), zr_table.dtype)
    heads = np.empty((steps, *h.shape[:2], 2), h.dtype)
    zr, n, q, u = np.empty((2, words.shape[1], 2 * HIDDEN), h.dtype), np.empty_like(h), np.empty_like(h), np.empty((2, words.shape[1], 2 * HIDDEN), h.dtype)
    for t in range(steps):
        for d, rows in enumerate((words[t], back[t])):
            np.take(zr_table[d], rows, 0, out=zr[d], mode="clip")
            np.take(n_table[d], rows, 0, out=n[d], mode="clip")
        np.matmul(h, p["zr"], out=u)
        zr += u
        _sigmoid(zr)
        np.matmul(h, p["n"], out=q)
        q += p["q_bias"]
        q *= zr[:, :, HIDDEN:]
        n += q
        np.tanh(n, out=n)
        h -= n
        h *= zr[:, :, :HIDDEN]
        h += n
        np.matmul(h, p["heads"], out=heads[t])
    return pooled(heads, lengths)[0] + p["bias"][0]


def gradients(network: Network, rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, words: np.ndarray, lengths: np.ndarray, labels: np.ndarray,
              weights: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """(mean loss, its gradient by parameter, logits) of windows whose distinct words are given by vocabulary rows and n-grams."""
    p, steps, dtype = network.p, len(words), network.p["zr"].dtype
    x = network.inputs(rows, grams, counts)
    zr_table, n_table = network.gates(x)
    places = np.stack([words, np.take_along_axis(words, reversed_places(lengths, steps), 0)], 1)  # (steps, direction, window)
    h = np.zeros((2, words.shape[1], HIDDEN), dtype)
    kept = []
    heads = np.empty((steps, 2, words.shape[1], 2), dtype)
    for t in range(steps):
        zr = np.stack([zr_table[d][places[t, d]] for d in (0, 1)]) + h @ p["zr"]
        zr = _sigmoid(zr)
        q = h @ p["n"] + p["q_bias"]
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        n = np.tanh(np.stack([n_table[d][places[t, d]] for d in (0, 1)]) + r * q)
        kept.append((h, z, r, q, n))
        h = n + z * (h - n)
        heads[t] = h @ p["heads"]
    total, weight, value = pooled(heads, lengths)
    logit = total + p["bias"][0]
    share = weights / weights.sum()
    loss = float((share * (np.logaddexp(0, logit) - labels * logit)).sum())
    out = ((1 / (1 + np.exp(-logit)) - labels) * share).astype(dtype)

    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"][0] = out.sum()
    d_value = weight * out
    d_score = d_value * (value - total)
    at_place = np.stack([d_score, d_value], 2).astype(dtype)
    d_heads = np.stack([at_place, np.take_along_axis(at_place, reversed_places(lengths, steps)[:, :, None], 0)], 1)  # the order of places turns back on itself
    d_zr, d_n = np.empty((steps, 2, words.shape[1], 2 * HIDDEN), dtype), np.empty((steps, 2, words.shape[1], HIDDEN), dtype)
    dh = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        before, z, r, q, n = kept[t]
        state = n + z * (before - n)
        g["heads"] += np.swapaxes(state, 1, 2) @ d_heads[t]
        dh = dh + d_heads[t] @ np.swapaxes(p["heads"], 1, 2)
        dn = dh * (1 - z) * (1 - n * n)
        d_n[t] = dn
        dq = dn * r
        d_zr[t, :, :, :HIDDEN] = dh * (before - n) * z * (1 - z)
        d_zr[t, :, :, HIDDEN:] = dn * q * r * (1 - r)
        g["zr"] += np.swapaxes(before, 1, 2) @ d_zr[t]
        g["n"] += np.swapaxes(before, 1, 2) @ dq
        g["q_bias"] += dq.sum(1, keepdims=True)
        dh = dh * z + d_zr[t] @ np.swapaxes(p["zr"], 1, 2) + dq @ np.swapaxes(p["n"], 1, 2)

    d_x = np.zeros_like(x)
    for d in (0, 1):
        flat = places[:, d].ravel()
        order = np.argsort(flat, kind="stable")
        have, heads_at = np.unique(flat[order], return_index=True)
        for name, d_gate in (("zr", d_zr), ("n", d_n)):
            sums = np.add.reduceat(d_gate[:, d].reshape(len(flat), -1)[order], heads_at, axis=0)
            g[f"{name}_in"][d] = x[have].T @ sums
            g[f"{name}_bias"][d, 0] = sums.sum(0)
            d_x[have] += sums @ p[f"{name}_in"][d].T
    np.add.at(g["words"], rows, d_x[:, :WORD_DIM])
    g["words"][0] = 0
    d_mean = d_x[:, WORD_DIM:] * (1 - x[:, WORD_DIM:] ** 2) / counts[:, None].astype(dtype)
    order = np.argsort(grams, kind="stable")
    have, heads_at = np.unique(grams[order], return_index=True)
    g["grams"][have] = np.add.reduceat(np.repeat(d_mean, counts, axis=0)[order], heads_at, axis=0)
    return loss, g, logit


def train(windows: list[list[str]], labels: np.ndarray, documents: np.ndarray, vocabulary: list[str], steps: int = 200, batch: int = 128, rate: float = 0.02, dropped: float = 0.3,
          seed: int = 1) -> Network:
    """A network fitted to windows and the labels of their documents, in so many steps of Adam.

    A window of a document with label 1 need not show why. After a third of the steps such a window counts only if the network itself gives it over one half, or more than the document's other
    windows. Words lose their own vector in a share ``dropped`` of all batches, so that n-grams must do without it too.
    """
    rng, network = np.random.default_rng(seed), Network.fresh(vocabulary, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    words = sorted({w for window in windows for w in window})
    number = {w: k for k, w in enumerate(words)}
    coded = [np.fromiter((number[w] for w in window), np.int64, len(window)) for window in windows]
    all_rows = network.rows(words)
    all_grams, all_counts = gram_rows(words)
    all_first = np.cumsum(all_counts) - all_counts
    lengths = np.array([len(w) for w in windows])
    counts_for, latest, step = np.ones(len(windows), bool), np.zeros(len(windows)), 0
    while step < steps:
        if 3 * step >= steps:
            best = np.full(documents.max() + 1, -np.inf)
            np.maximum.at(best, documents, latest)
            counts_for = (labels == 0) | (latest > 0) | (latest >= best[documents])
        order = np.flatnonzero(counts_for)
        order = order[np.argsort(lengths[order] // 16 + rng.random(len(order)), kind="stable")]  # like lengths together
        parts = [order[k:k + batch] for k in range(0, len(order), batch)]
        for k in rng.permutation(len(parts))[:steps - step]:
            at = parts[k]
            seen, places = np.unique(np.concatenate([coded[i] for i in at]), return_inverse=True)
            matrix = np.zeros((int(lengths[at].max()), len(at)), np.int64)
            matrix.T[np.arange(len(matrix)) < lengths[at][:, None]] = places
            rows = np.where(rng.random(len(seen)) < dropped, 0, all_rows[seen])
            counts = all_counts[seen]
            grams = all_grams[np.repeat(all_first[seen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            classes = np.bincount(labels[at], minlength=2).astype(float)
            weights = np.where(labels[at] == 1, 1 / max(1, classes[1]), 1 / max(1, classes[0]))
            _, g, latest[at] = gradients(network, rows, grams, counts, matrix, lengths[at], labels[at], weights)
            step += 1
            shrink = np.float32(min(1.0, 1 / max(1e-9, np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))))
            for name, value in g.items():
                value *= shrink
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.01 * (value * value - v)
                network.p[name] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return network
