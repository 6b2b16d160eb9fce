"""Words of whole texts as numbers, a batch at a time.

Texts are decoded into one array of code points; a table gives each code point what
it folds to (see ``charmap.fold``), and words, their hashes and their texts follow by
array operations. Memory is bounded by the batch, which ``slices`` keeps below a
number of characters; one text larger than that forms a batch of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np

from .charmap import assigned, fold

_SEVERAL = np.uint32(0xFFFFFFFF)
_SPACE = np.uint32(32)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def slices(lengths: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many characters together."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


@cache
def _table() -> tuple[np.ndarray, dict[int, str]]:
    """What each code point folds to (0: nothing, 32: a gap between words), and those that fold to several."""
    codes, several = np.full(sys.maxunicode + 1, _SPACE, np.uint32), {}
    for c in assigned():
        to = fold(c)
        if len(to) > 1:
            codes[ord(c)], several[ord(c)] = _SEVERAL, to
        else:
            codes[ord(c)] = ord(to) if to else 0
    return codes, several


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts, each ended by a gap, and where each text starts (one more for the end)."""
    codes, several = _table()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = codes[raw]
    if (at := np.flatnonzero(folded == _SEVERAL)).size:
        return fold_texts(["".join(several.get(ord(c), c) for c in t) for t in texts])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    keep = folded != 0
    starts = np.concatenate([[0], np.cumsum(keep)[ends - 1]]) if len(texts) else np.zeros(1, np.int64)
    return folded[keep], starts


def hash_runs(chars: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of characters, given the place of each in its run and where runs start."""
    power = np.cumprod(np.full(int(place.max()) + 1, _B, np.uint64), dtype=np.uint64)
    return mix(np.add.reduceat(mix((chars.astype(np.uint64) + np.uint64(1)) * _A) * power[place], starts))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the number of its text, and the folded code points with the starts of the texts."""
    chars, starts = fold_texts(texts)
    letter = chars != _SPACE
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = np.flatnonzero(first)
    if not begin.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), chars, starts
    at = np.flatnonzero(letter)
    word = np.cumsum(first)[at] - 1
    place = at - begin[word]
    hashes = hash_runs(chars[at], place, np.searchsorted(at, begin))
    return hashes, np.searchsorted(starts, begin, side="right") - 1, chars, starts


def shingles(hashes: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Positions whose k words lie in one text."""
    n = len(hashes) - k + 1
    return np.flatnonzero(text[:n] == text[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _B + hashes[j : j + n]
    return mix(out)


def word_text(chars: np.ndarray) -> str:
    """Folded code points as words with one space before, between and after."""
    return " " + " ".join(chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()) + " "
