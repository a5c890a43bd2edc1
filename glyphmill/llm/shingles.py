"""Word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from glyphmill.llm.lattice import words_of

WORDS_KEPT = 300_000
ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a hash: shifts and multiplications by odd constants, wrapping."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64 bits for each string of ``length`` bytes: polynomials of powers of two, joined, and mixed at the end."""
    part, have, out, n = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if length & have:
            if out is None:
                out = part
            else:  # the longer part goes in front
                whole = len(data) - n - have + 1
                out = part[:whole] * np.uint64(ODD ** (have + n) % (1 << 64)) + out[have : have + whole]
            n += have
        if 2 * have > length:
            return mixed(out)
        part = part[: len(part) - have] * np.uint64(ODD**have % (1 << 64)) + part[have:]
        have *= 2


class Shingler:
    """Distinct shingles of ``n`` words in ascending order of their hashes; a shorter text is one shingle, an empty one none."""

    def __init__(self, n: int):
        self.n, self.words, self.codes = n, {}, np.empty(4096, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words, new = {}, set(words)
        if new:
            at = len(self.words)
            if at + len(new) > len(self.codes):
                self.codes = np.concatenate([self.codes, np.empty(max(len(self.codes), len(new)), np.uint64)])
            for i, w in enumerate(new, at):
                self.words[w] = i
                self.codes[i] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        code = self.codes[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = mixed(out + code[i : len(words) - n + 1 + i])
        return np.unique(out)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
