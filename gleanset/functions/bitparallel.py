"""The measures of similarity.py for one string against many at once: a bit of a 64-bit word for each character.

A step of the text advances the tables of all strings together (Myers, 1999; Hyyro, 2004), so that a pair costs some
nanoseconds a character. Strings of more than 64 characters take the plain functions."""

from __future__ import annotations

import numpy as np

from gleanset.functions import similarity as s
from gleanset.functions.text import FUNCTION_WORDS

WORD = 64
ONE = np.uint64(1)
ALL = np.uint64(2**64 - 1)


class Strings:
    """Strings to be compared with: where each character stands in them."""

    def __init__(self, values: list[str]):
        self.values = values
        self.size = np.array([len(v) for v in values], np.int64)
        self.long = [i for i, v in enumerate(values) if len(v) > WORD]
        self.where: dict[str, np.ndarray] = {}
        for i, v in enumerate(values):
            for at, c in enumerate(v[:WORD]):
                mask = self.where.get(c)
                if mask is None:
                    mask = self.where[c] = np.zeros(len(values), np.uint64)
                mask[i] |= ONE << np.uint64(at)
        self.full = np.where(self.size >= WORD, ALL, (ONE << np.minimum(self.size, WORD - 1).astype(np.uint64)) - ONE)
        self.last = np.maximum(np.minimum(self.size, WORD) - 1, 0).astype(np.uint64)
        self.none = np.zeros(len(values), np.uint64)

    def lcs(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence with each string."""
        row = np.full(len(self.values), ALL)
        with np.errstate(over="ignore"):
            for c in text:
                if (mask := self.where.get(c)) is not None:
                    hit = row & mask
                    row = (row + hit) | (row - hit)
        out = np.bitwise_count(~row & self.full).astype(np.int64)
        for i in self.long:
            out[i] = s.lcs(self.values[i], text)
        return out

    def edits(self, text: str) -> np.ndarray:
        """Levenshtein distance to each string."""
        plus, minus, score = np.full(len(self.values), ALL), self.none, self.size.copy()
        with np.errstate(over="ignore"):
            for c in text:
                same = self.where.get(c, self.none)
                v = same | minus
                h = (((same & plus) + plus) ^ plus) | same
                up, down = minus | ~(h | plus), plus & h
                score += ((up >> self.last) & ONE).astype(np.int64) - ((down >> self.last) & ONE).astype(np.int64)
                up, down = (up << ONE) | ONE, down << ONE
                plus, minus = down | ~(v | up), up & v
        score[self.size == 0] = len(text)
        for i in self.long:
            score[i] = s.edits(self.values[i], text)
        return score

    def shared(self, text: str) -> np.ndarray:
        """Twice the common subsequence over both lengths. At least as large as 1 - edits / longer length."""
        return 2 * self.lcs(text) / np.maximum(self.size + len(text), 1)


class Compared:
    """Strings with their consonants: consonant and token similarity."""

    def __init__(self, values: list[str]):
        self.values, self.own = values, Strings(values)
        self.bones = Strings([s.skeleton(v) for v in values])
        self.canonical = np.array([FUNCTION_WORDS.get(v, v) for v in values], object)

    def consonant(self, text: str) -> np.ndarray:
        bones = s.skeleton(text)
        return np.where(self.bones.size > 0, self.bones.shared(bones), 0.0) if bones else np.zeros(len(self.values))

    def token(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(len(self.values))
        common = self.own.lcs(text)
        size, n = self.own.size, len(text)
        out = np.maximum(2 * common / np.maximum(size + n, 1), 0.94 * self.consonant(text))
        for i in np.nonzero((common == np.minimum(size, n)) & (size > 0))[0]:
            a, b = self.values[i], text
            if a == b:
                out[i] = 1.0
            elif a.startswith(b) or b.startswith(a):
                out[i] = max(out[i], 0.72 + 0.28 * min(len(a), n) / max(len(a), n))
        if text in FUNCTION_WORDS:
            out[(self.canonical == FUNCTION_WORDS[text]) & (out < 1)] = 0.92
        return np.where(size > 0, out, 0.0)
