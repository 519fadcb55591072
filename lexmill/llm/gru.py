"""A bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is the embedding of the word (hashed) beside the scaled sum of the embeddings of its character n-grams (hashed,
with marks at both ends). Both directions of the recurrence start at zero in each window of words; attention pools their
states; one linear unit gives the window's logit. A text's logit is the largest of its windows'.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

WORD_BUCKETS = 1 << 13
GRAM_BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
EMBED = 12
HIDDEN = 8
ATTEND = 8
WINDOW = 32
STRIDE = 16
#: Words whose inputs a worker keeps; beyond that it starts anew. Words and windows that are worked on at once.
CACHE = 150_000
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 4096, 1024
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FOLD = _SPACE.lower()
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashed_inputs(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; n-gram buckets of all words one after another; how many n-grams each word has (1 or more)."""
    marked = b"".join([b"^" + w + b"$" for w in words])
    raw = np.frombuffer(marked, dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    left = np.repeat(start + size, size) - np.arange(len(raw))  # bytes from here to the word's end
    place = np.arange(len(raw)) - np.repeat(start, size)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int(size.max()) - 1), _P)])) if len(size) else np.zeros(1, dtype=np.uint64)
    word = np.add.reduceat((raw + np.uint64(1)) * power[place], start) if len(words) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    value = np.zeros(len(raw), dtype=np.uint64)
    grams, owners = [], []
    for n in range(1, GRAMS[-1] + 1):
        reach = len(raw) - n + 1
        if reach <= 0:
            break
        value = value[:reach] * _P + raw[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            own = np.flatnonzero(left[:reach] >= n)
            grams.append(_scramble(value[own] * np.uint64(2 * n + 1)) % np.uint64(GRAM_BUCKETS))
            owners.append(owner[own])
    gram = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
    by = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    order = np.argsort(by, kind="stable")
    return (_scramble(word) % np.uint64(WORD_BUCKETS)).astype(np.int64), gram[order].astype(np.int64), np.bincount(by, minlength=len(words))


def windows_of(n_words: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts that follow one another: first word, words in it, text. A text without words has one, of none."""
    n = np.asarray(n_words, dtype=np.int64)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    offset = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    begin = (np.cumsum(n) - n)[text] + offset
    return begin, np.minimum(WINDOW, n[text] - offset), text


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    word: np.ndarray
    gram: np.ndarray
    inputs: np.ndarray  # (2 * EMBED, 6 * HIDDEN): update, reset, candidate of one direction, then of the other
    bias: np.ndarray  # (6 * HIDDEN,)
    state: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    attend: np.ndarray  # (2 * HIDDEN, ATTEND)
    attend_out: np.ndarray  # (ATTEND,)
    out: np.ndarray  # (2 * HIDDEN,)
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.float32))
    known: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)  # of the logit, to give a probability

    @staticmethod
    def start(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape, sd: (rng.standard_normal(shape) * sd).astype(np.float32)
        return Network(f(WORD_BUCKETS, EMBED, sd=0.1), f(GRAM_BUCKETS, EMBED, sd=0.1), f(2 * EMBED, 6 * HIDDEN, sd=0.3), np.zeros(6 * HIDDEN, dtype=np.float32), f(2, HIDDEN, 3 * HIDDEN, sd=0.3), f(2 * HIDDEN, ATTEND, sd=0.3), f(ATTEND, sd=0.3), f(2 * HIDDEN, sd=0.3))

    def parameters(self) -> dict[str, np.ndarray]:
        return {k: v for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}

    def keep_only(self, words: np.ndarray, grams: np.ndarray) -> None:
        """Embeddings of the other buckets are zero, and stay so."""
        self.word *= words[:, None]
        self.gram *= grams[:, None]
        self.known = {"word": words[:, None], "gram": grams[:, None]}

    def vectors(self, words: Sequence[bytes]) -> tuple[np.ndarray, tuple]:
        bucket, gram, n = hashed_inputs(words)
        start = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        norm = (1 / np.sqrt(n)).astype(np.float32)[:, None]
        sums = np.add.reduceat(self.gram[gram], start, axis=0) if len(words) else np.zeros((0, EMBED), dtype=np.float32)
        return np.concatenate([self.word[bucket], sums * norm], axis=1), (bucket, gram, n, norm)

    def projected(self, words: Sequence[bytes]) -> np.ndarray:
        return np.concatenate([self.vectors(words[i : i + WORDS_AT_ONCE])[0] @ self.inputs + self.bias for i in range(0, len(words), WORDS_AT_ONCE)] + [np.zeros((0, 6 * HIDDEN), dtype=np.float32)])

    def run(self, table: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows: ids (windows, WINDOW) are rows of table, only the first `size` of each count. table has the inputs of both
        directions beside each other, or is a table for each direction."""
        b, H = len(ids), HIDDEN
        length = max(1, int(size.max()) if b else 1)
        states = np.zeros((length, b, 2 * H), dtype=np.float32)
        steps = {}
        for way in (0, 1):
            h, u = np.zeros((b, H), dtype=np.float32), self.state[way]
            at = slice(3 * H * way, 3 * H * (way + 1))
            rows = table[way] if table.ndim == 3 else np.ascontiguousarray(table[:, at])
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                x, s = rows[ids[:, t]], h @ u
                gates = sigmoid(x[:, : 2 * H] + s[:, : 2 * H])
                z, r = gates[:, :H], gates[:, H:]
                c = np.tanh(x[:, 2 * H :] + r * s[:, 2 * H :])
                new = c + z * (h - c)
                if not (size > t).all():
                    new = np.where((size > t)[:, None], new, h)
                if keep:
                    steps[way, t] = (h, z, r, c, s[:, 2 * H :])
                h = new
                states[t, :, H * way : H * (way + 1)] = h
        a = np.tanh(states @ self.attend)
        e = a @ self.attend_out
        e = np.where(np.arange(length)[:, None] < np.maximum(size, 1), e, np.float32(-1e9))
        p = np.exp(e - e.max(axis=0))
        p /= p.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", p, states)
        logit = pooled @ self.out + self.shift[0]
        return (logit, states, steps, a, p, pooled) if keep else logit

    def gradients(self, words: Sequence[bytes], ids: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy, with respect to all parameters."""
        H = HIDDEN
        vec, (bucket, gram, n, norm) = self.vectors(words)
        table = vec @ self.inputs + self.bias
        logit, states, steps, a, p, pooled = self.run(table, ids, size, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.parameters().items()}
        d = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g["out"], g["shift"][0] = pooled.T @ d, d.sum()
        dpool = d[:, None] * self.out
        dstates = p[:, :, None] * dpool
        dp = np.einsum("tbh,bh->tb", states, dpool)
        de = p * (dp - (p * dp).sum(axis=0))
        g["attend_out"] = np.einsum("tb,tba->a", de, a)
        da = de[:, :, None] * self.attend_out * (1 - a * a)
        g["attend"] = np.einsum("tbh,tba->ha", states, da)
        dstates += da @ self.attend.T
        dtable = np.zeros_like(table)
        for way in (0, 1):
            u, dh = self.state[way], np.zeros((len(ids), H), dtype=np.float32)
            for t in range(len(states) - 1, -1, -1) if way == 0 else range(len(states)):
                h, z, r, c, sc = steps[way, t]
                dh = dh + dstates[t, :, H * way : H * (way + 1)]
                on = (size > t)[:, None].astype(np.float32)
                dnew = dh * on
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * sc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                ds = np.concatenate([dz, dr, dc * r], axis=1)
                g["state"][way] += h.T @ ds
                np.add.at(dtable, (ids[:, t], slice(3 * H * way, 3 * H * (way + 1))), dx)
                dh = dh * (1 - on) + dnew * z + ds @ u.T
        g["bias"] = dtable.sum(axis=0)
        g["inputs"] = vec.T @ dtable
        dvec = dtable @ self.inputs.T
        np.add.at(g["word"], bucket, dvec[:, :EMBED])
        np.add.at(g["gram"], gram, np.repeat(dvec[:, EMBED:] * norm, n, axis=0))
        return g

    def fit(self, windows: list[tuple[list[bytes], float, float]], steps: int, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over windows (words, label, weight), drawn by turns in shuffled order."""
        rng, order, at = np.random.default_rng(seed), np.zeros(0, dtype=np.int64), 0
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.parameters().items()}
        for step in range(1, steps + 1):
            if at + batch > len(order):
                order, at = np.concatenate([order[at:], rng.permutation(len(windows))]), 0
            chosen = [windows[i] for i in order[at : at + batch]]
            at += batch
            vocabulary: dict[bytes, int] = {}
            ids = np.zeros((len(chosen), WINDOW), dtype=np.int64)
            for i, (ws, _, _) in enumerate(chosen):
                ids[i, : len(ws)] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
            if not vocabulary:
                continue
            g = self.gradients(list(vocabulary), ids, np.array([len(c[0]) for c in chosen]), np.array([c[1] for c in chosen], dtype=np.float32), np.array([c[2] for c in chosen], dtype=np.float32))
            for k, v in self.known.items():
                g[k] *= v
            slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in self.parameters().items():
                m, q = moment[k]
                m += 0.1 * (g[k] - m)
                q += 0.01 * (g[k] * g[k] - q)
                v -= slow * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)


class Scorer:
    """Scores texts; keeps the inputs of the words seen lately."""

    class _Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    def __init__(self, network: Network, cache: int = CACHE):
        self.network, self.cache = network, cache
        self._clear()

    def _clear(self) -> None:
        self.ids, self.table, self.filled = Scorer._Ids(), np.zeros((2, 1024, 3 * HIDDEN), dtype=np.float32), 0

    def window_logits(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, and the text of each."""
        if len(self.ids) > self.cache:
            self._clear()
        lists = [words_of(t) for t in texts]
        sizes = [len(x) for x in lists]
        flat = np.concatenate([np.fromiter(map(self.ids.__getitem__, x), dtype=np.int64, count=len(x)) for x in lists] + [np.zeros(WINDOW, dtype=np.int64)])
        if len(self.ids) > self.filled:
            fresh = list(islice(self.ids, self.filled, None))
            if len(self.ids) > self.table.shape[1]:
                grown = np.zeros((2, len(self.ids) * 5 // 4, 3 * HIDDEN), dtype=np.float32)
                grown[:, : self.filled] = self.table[:, : self.filled]
                self.table = grown
            for i in range(0, len(fresh), WORDS_AT_ONCE):
                part = self.network.projected(fresh[i : i + WORDS_AT_ONCE])
                for way in (0, 1):
                    self.table[way, self.filled + i : self.filled + i + len(part)] = part[:, 3 * HIDDEN * way : 3 * HIDDEN * (way + 1)]
            self.filled = len(self.ids)
        begin, size, text = windows_of(sizes)
        logits = np.zeros(len(begin), dtype=np.float32)
        for i in range(0, len(begin), WINDOWS_AT_ONCE):
            here = begin[i : i + WINDOWS_AT_ONCE, None] + np.arange(WINDOW)
            logits[i : i + WINDOWS_AT_ONCE] = self.network.run(self.table, flat[np.minimum(here, len(flat) - 1)], size[i : i + WINDOWS_AT_ONCE])
        return logits, text

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability for each text."""
        logits, text = self.window_logits(texts)
        best = np.full(len(texts), -np.inf, dtype=np.float64)
        np.maximum.at(best, text, logits)
        a, b = self.network.scale
        return 1 / (1 + np.exp(-(a * best + b)))
