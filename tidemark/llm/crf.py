"""Linear-chain conditional random field over words, in numpy.

A word's score for a label is the sum of the weights of its hashed features: prefixes and
suffixes of up to four letters, letter n-grams of two and three, and the word itself (the lexicon).
Labels of neighbouring words interact by learned transitions. Marginals come from
forward-backward in probabilities.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Sequence

import numpy as np

#: Numbers that are neither letters nor digits, such as fractions and circled numbers.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
RUN = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(rf"[^{re.escape(NUMBERS)}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters. Only the rare runs that hold such numbers are cut again."""
    found = RUN.findall(text)
    if not all(map(str.isalpha, found)):
        found = [w for run in found for w in ([run] if run.isalpha() else LETTERS.findall(run))]
    return found
BITS = 17


def features(word: str) -> list[int]:
    """Hashed affixes, n-grams and the word itself, of the lower-case word, whole however long."""
    w = word.lower()
    found = [f"w{w}"]
    for k in range(1, min(4, len(w)) + 1):
        found += (f"p{w[:k]}", f"s{w[-k:]}")
    b = f"<{w}>"
    found += ["g" + b[i:i + k] for k in (2, 3) for i in range(len(b) - k + 1)]
    return [zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in set(found)]


def word_scores(words: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """Label scores of each word: mean feature weight times the root of their number."""
    out = np.zeros((len(words), weights.shape[1]))
    for begin in range(0, len(words), 5_000):
        lists = [features(w) for w in words[begin:begin + 5_000]]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((f for l in lists for f in l), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
        out[begin:begin + 5_000] = sums / np.sqrt(sizes)[:, None]
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def marginals(scores: np.ndarray, begins: np.ndarray, moves: np.ndarray, segment: int = 128) -> np.ndarray:
    """Label marginals of all words; texts begin at ``begins`` and none is empty. Exact.

    Texts are cut into segments that run side by side. The product of a segment's steps carries a
    message through it, so chains of these give each segment what enters on either side.
    """
    n, labels = scores.shape
    if not n:
        return np.zeros((0, labels))
    e, m = potentials(scores), np.exp(moves - moves.max())
    sizes = np.diff(np.append(begins, n))
    pieces = -(-sizes // segment)
    depth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begins, pieces) + depth * segment
    size = np.minimum(segment, np.repeat(begins + sizes, pieces) - starts)
    # Longest first: the segments still running at step t are the first active[t].
    order = np.argsort(-size, kind="stable")
    at, long = starts[order], size[order]
    active = [int(np.searchsorted(-long, -t, "left")) for t in range(int(long[0]) + 1)]
    enter, leave = np.ones((len(starts), labels)), np.ones((len(starts), labels))
    if int(depth.max()):
        through = np.eye(labels)[None] * e[at][:, None, :]
        for t in range(1, len(active) - 1):
            k = active[t]
            now = (through[:k] @ m) * e[at[:k] + t][:, None, :]
            through[:k] = now / now.max(axis=(1, 2), keepdims=True)
        whole = np.empty_like(through)
        whole[order] = through
        for d in range(1, int(depth.max()) + 1):
            i = np.flatnonzero(depth == d)
            enter[i] = _normal(((enter[i - 1][:, None, :] @ whole[i - 1])[:, 0] @ m))
        for d in range(int(depth.max()), 0, -1):
            i = np.flatnonzero(depth == d)
            leave[i - 1] = _normal((whole[i] @ leave[i][:, :, None])[:, :, 0] @ m.T)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = _normal(enter[order] * e[at])
    alpha[at] = now
    for t in range(1, len(active) - 1):
        k = active[t]
        now = _normal((now[:k] @ m) * e[at[:k] + t])
        alpha[at[:k] + t] = now
    last = leave[order]
    now = last[:0]
    for t in range(len(active) - 2, -1, -1):
        k, old = active[t], len(now)
        back = _normal((now * e[at[:old] + t + 1]) @ m.T) if old else now
        now = np.concatenate([back, last[old:k]])
        beta[at[:k] + t] = now
    return _normal(alpha * beta)


def train(
    words: list[str], labels: np.ndarray, n_labels: int, lane: int = 48, lanes: int = 64, epochs: int = 3,
    rate: float = 0.2, decay: float = 1e-6, seed: int = 5,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by labels) and transitions from a stream of labelled words, cut into
    lanes, by AdaGrad on the log-likelihood with forward-backward expectations."""
    weights, moves = np.zeros((1 << BITS, n_labels)), np.zeros((n_labels, n_labels))
    sum_w, sum_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    lane = max(1, min(lane, len(words)))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    lists = [np.array(features(w), np.int64) for w in vocabulary]
    index = np.array([vocabulary[w] for w in words], np.int64)
    n = len(words) // lane * lane
    rows = np.arange(n).reshape(-1, lane)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if n else 0):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // lanes)):
            at = rows[batch].ravel()
            found = [lists[i] for i in index[at].tolist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate(found)
            scale = 1 / np.sqrt(sizes)
            scores = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0) * scale[:, None]
            truth = labels[at]
            p, pairs = _expected(scores.reshape(-1, lane, n_labels), moves)
            p[np.arange(len(at)), truth] -= 1
            grad = p * scale[:, None]
            pair = truth.reshape(-1, lane)
            np.add.at(pairs, (pair[:, :-1].ravel(), pair[:, 1:].ravel()), -1)
            touched, place = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(at)), sizes)
            g = np.stack([np.bincount(place, grad[owner, l], minlength=len(touched)) for l in range(n_labels)], axis=1)
            g += decay * weights[touched]
            sum_w[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(sum_w[touched])
            sum_m += pairs * pairs
            moves -= rate * pairs / np.sqrt(sum_m)
    return weights, moves


def _expected(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, one row a word, and expected transitions, of lanes (lanes, steps, labels)."""
    e, m = potentials(scores), np.exp(moves - moves.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = _normal(e[:, 0])
    for t in range(1, e.shape[1]):
        alpha[:, t] = _normal((alpha[:, t - 1] @ m) * e[:, t])
    for t in range(e.shape[1] - 2, -1, -1):
        beta[:, t] = _normal((beta[:, t + 1] * e[:, t + 1]) @ m.T)
    pairs = alpha[:, :-1, :, None] * m * (e * beta)[:, 1:, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return _normal(alpha * beta).reshape(-1, e.shape[2]), pairs.sum(axis=(0, 1))
