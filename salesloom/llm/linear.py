"""Sparse logistic regression over hashed words, trained by follow-the-regularised-leader updates."""

import re
import zlib

import numpy as np

#: Token hashes remembered by one Python process before it starts anew.
REMEMBERED = 50_000


class Hashes(dict):
    """32-bit hashes of tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


_HASHES = Hashes()


def _spread(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(text: str, pattern: re.Pattern, bits: int) -> np.ndarray:
    """Hashed one-word and two-word features of a text in order, repeats included, below 2^bits.

    A word that stands twice in a row has one and the same two-word feature whatever the word is.
    """
    tokens = pattern.findall(text)
    one = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    if len(one) < 2:
        return _spread(one, bits)
    two = (one[:-1] << np.uint64(1)) ^ (one[1:] * np.uint64(0x85EBCA77)) ^ np.uint64(1 << 63)
    two[one[:-1] == one[1:]] = np.uint64(1 << 62)
    return _spread(np.concatenate([one, two]), bits)


class Stems(dict):
    """Hashes of a word and of its first letters."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        value = self[word] = (zlib.crc32(raw), 1 << 32 | zlib.crc32(word[:4].encode("utf-8", "surrogatepass")), 1 << 33 | zlib.crc32(word[:6].encode("utf-8", "surrogatepass")))
        return value


_STEMS = Stems()


def stems(text: str, pattern: re.Pattern, bits: int) -> np.ndarray:
    """Different hashed words and beginnings of words of a lower-cased text, below 2^bits."""
    words = set(pattern.findall(text.lower()))
    found = np.array([_STEMS[w] for w in words], np.uint64).reshape(-1)
    return np.unique(_spread(found, bits))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, *, alpha: float = 0.1, beta: float = 1.0,
        l1: float = 1.0, l2: float = 1.0, epochs: int = 2, seed: int = 1) -> np.ndarray:
    """Weights for rows of (different feature numbers, values): per-coordinate steps shrink with the gradients seen
    there, and a weight is zero until its gradients add up to more than `l1`."""
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            near, root = z[at], np.sqrt(n[at])
            w = np.where(np.abs(near) <= l1, 0.0, (np.sign(near) * l1 - near) / ((beta + root) / alpha + l2))
            gradient = (sigmoid(w @ x) - labels[i]) * x
            after = root * root + gradient * gradient
            z[at] = near + gradient - (np.sqrt(after) - root) / alpha * w
            n[at] = after
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
