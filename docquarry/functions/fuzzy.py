"""Fuzzy ratios of strings (0 to 100) as Arrow-batched functions: partial ratio and token set ratio."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one machine word of bits per character of ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 100 for two empty strings."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


@lru_cache(maxsize=50_000)
def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one (windows may stick out at either end).

    A window shares at most as many characters as their counts allow, so windows are tried
    from the greatest such bound down, until none left can be better.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, codes = len(a), np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.maximum(np.arange(1 - n, len(b)), 0)
    high = np.minimum(np.arange(1, len(b) + n), len(b))
    shared = np.zeros(len(low), np.int64)
    for letter, count in Counter(a).items():
        before = np.concatenate([[0], np.cumsum(codes == ord(letter))])
        shared += np.minimum(before[high] - before[low], count)
    bound, best = 200.0 * shared / (n + high - low), 0.0
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] <= best:
            break
        best = max(best, ratio(a, b[low[i] : high[i]]))
    return best


class Titles:
    """Strings of which a text's :func:`partial_ratio` is asked, all at once: windows are lanes of 64-bit words, a bit for each character of the shorter string.

    Texts over ``LONG`` characters, and pairs whose shorter string has over 64, are compared one by one.
    """

    LONG = 2_000
    #: Lanes worked on at a time.
    LANES = 2**19

    def __init__(self, titles: list[str]):
        self.titles = titles
        self.order = sorted((k for k, t in enumerate(titles) if t), key=lambda k: -len(titles[k]))
        self.sizes = np.array([len(titles[k]) for k in self.order], np.int64)
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(titles))))}
        self.codes = np.full((len(self.order), int(self.sizes.max(initial=0))), len(self.letters), np.int64)
        self.masks = np.zeros((len(self.letters) + 1, len(self.order)), np.uint64)
        for row, k in enumerate(self.order):
            for i, c in enumerate(titles[k]):
                self.codes[row, i] = self.letters[c]
                if i < 64:
                    self.masks[self.letters[c], row] |= np.uint64(1 << i)

    def partial_ratios(self, text: str) -> list[float]:
        """The partial ratio of every string with ``text``, in their order."""
        if not text or len(text) > self.LONG:
            return [partial_ratio(t, text) for t in self.titles]
        size, out = len(text), [0.0] * len(self.titles)
        longer = int((self.sizes > size).sum())  # the first of them
        first = int((self.sizes > 64).sum())
        found = np.empty(len(self.order))
        at = np.array([self.letters.get(c, len(self.letters)) for c in text], np.int64)
        if size <= 64 and longer:  # windows of the string
            own = np.zeros(len(self.letters) + 1, np.uint64)
            for i, c in enumerate(at):
                own[c] |= np.uint64(1 << i)
            own[-1] = 0
            found[:longer] = self._best(own[self.codes[:longer]], np.full(longer, size), self.sizes[:longer])
        elif longer:
            found[:longer] = [partial_ratio(self.titles[k], text) for k in self.order[:longer]]
        start = max(longer, first)  # windows of the text
        found[longer:start] = [partial_ratio(self.titles[k], text) for k in self.order[longer:start]]
        if start < len(self.order):
            found[start:] = self._best(self.masks[at][:, start:].T, self.sizes[start:], np.full(len(self.order) - start, size))
        for k, score in zip(self.order, found.tolist(), strict=True):
            out[k] = score
        return out

    def _best(self, masks: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        rows = max(1, self.LANES // (masks.shape[1] + 2 * int(n.max())))
        return np.concatenate([self._best_rows(masks[i : i + rows], n[i : i + rows], size[i : i + rows]) for i in range(0, len(masks), rows)])

    @staticmethod
    def _best_rows(masks: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best ratio per row of a string of ``n`` characters (falling) with the windows of one of ``size``, whose characters are bits in ``masks``."""
        most, width = int(n.max()), masks.shape[1]
        padded = np.zeros((len(masks), width + 2 * (most - 1)), np.uint64)
        padded[:, most - 1 : most - 1 + width] = masks
        v = np.full((len(masks), width + most - 1), ~np.uint64(0))
        for step in range(most):
            rows = int((n > step).sum())
            part = v[:rows]
            u = part & padded[:rows, step : step + width + most - 1]
            v[:rows] = (part + u) | (part - u)
        starts = np.arange(1 - most, width)[None, :]
        windows = np.maximum(np.minimum(starts + n[:, None], size[:, None]) - np.maximum(starts, 0), 0)
        return (200.0 * (64 - np.bitwise_count(v).astype(np.int64)) / (n[:, None] + windows)).max(axis=1)


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common words, and those with either side's other words; 100 where one side has no others."""
    x, y = set(re.findall(r"\S+", a)), set(re.findall(r"\S+", b))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    pairs = [(with_a, with_b)] + ([(both, with_a), (both, with_b)] if both else [])
    return max(ratio(p, q) for p, q in pairs)


class Labels:
    """Labels of candidates, of which the one with the best :func:`token_set_ratio` of a text is asked; equal ratios by candidate.

    The result is that of comparing every label: shared characters bound a ratio, shared words give its other parts,
    labels without a shared word are compared at once (a bit for each character, up to 64), others from the greatest
    bound down until none left can be better.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        least: dict[str, str] = {}
        for candidate, label in pairs:
            low = label.lower()
            least[low] = min(candidate, least.get(low, candidate))
        self.rows = sorted((candidate, low) for low, candidate in least.items())
        self.size, self.count = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), np.int64)
        words: dict[str, list[int]] = {}
        letters: dict[str, list[tuple[int, int, int]]] = {}
        for at, (_, label) in enumerate(self.rows):
            own = set(re.findall(r"\S+", label))
            plain = " ".join(sorted(own))
            self.size[at], self.count[at] = len(plain), len(own)
            for w in own:
                words.setdefault(w, []).append(at)
            places: dict[str, list[int]] = {}
            for i, c in enumerate(plain):
                places.setdefault(c, []).append(i)
            for c, found in places.items():
                letters.setdefault(c, []).append((at, len(found), sum(1 << i for i in found) if len(plain) <= 64 else 0))
        self.words = {w: np.array(found) for w, found in words.items()}
        self.letters = {c: tuple(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.int64, np.int64, np.uint64), strict=True)) for c, found in letters.items()}

    def best(self, text: str, least: float) -> tuple[str, float] | None:
        """The candidate and ratio of the best label with at least ``least``, or none."""
        if not self.rows:
            return None
        low = text.lower()
        words = set(re.findall(r"\S+", low))
        plain = " ".join(sorted(words))
        score, bound = self._bounds(words, plain)
        alone = (bound >= max(least, score.max())) & (bound > score) & (self.size <= 64)
        for w in words & self.words.keys():
            alone[self.words[w]] = False
        if alone.any():
            bits, kept = np.full(len(self.rows), ~np.uint64(0)), {}
            for c in plain:
                if c not in kept and c in self.letters:
                    ids, _, masks = self.letters[c]
                    mine = alone[ids]
                    kept[c] = ids[mine], masks[mine]
                if c in kept:
                    ids, masks = kept[c]
                    v = bits[ids]
                    u = v & masks
                    bits[ids] = (v + u) | (v - u)
            score[alone] = bound[alone] = 200.0 * (64 - np.bitwise_count(bits[alone]).astype(np.int64)) / (len(plain) + self.size[alone])
        at = int(score.argmax())
        rest = np.flatnonzero((bound > score) & (bound >= max(least, score[at])))
        for j in rest[np.argsort(-bound[rest], kind="stable")]:
            if bound[j] < max(least, score[at]):
                break
            if bound[j] > score[at] or j < at:
                score[j] = token_set_ratio(low, self.rows[j][1])
                if score[j] > score[at] or (score[j] == score[at] and j < at):
                    at = int(j)
        return (self.rows[at][0], float(score[at])) if score[at] >= least else None

    def _bounds(self, words: set[str], plain: str) -> tuple[np.ndarray, np.ndarray]:
        """Per label the ratio as far as shared words alone give it, and one that the ratio can't exceed."""
        score, shared = np.zeros(len(self.rows)), np.zeros(len(self.rows), np.int64)
        if not words:
            return score, score.copy()
        for c, n in Counter(plain).items():
            if c in self.letters:
                ids, counts, _ = self.letters[c]
                shared[ids] += np.minimum(counts, n)
        both, held = np.full(len(self.rows), -1, np.int64), np.zeros(len(self.rows), np.int64)
        for w in words & self.words.keys():
            both[self.words[w]] += len(w) + 1
            held[self.words[w]] += 1
        some = np.flatnonzero(held)
        score[some] = 200.0 * both[some] / (both[some] + np.minimum(len(plain), self.size[some]))
        score[some[(held[some] == len(words)) | (held[some] == self.count[some])]] = 100.0
        return score, np.maximum(score, 200.0 * shared / (len(plain) + self.size))


def _column(f, a: Column, b: Column) -> Column:
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(batch, "double")(a, b)


def partial_ratio_column(a: Column, b: Column) -> Column:
    """:func:`partial_ratio` of two columns; null for nulls."""
    return _column(partial_ratio, a, b)


def token_set_ratio_column(a: Column, b: Column) -> Column:
    """:func:`token_set_ratio` of two columns; null for nulls."""
    return _column(token_set_ratio, a, b)
