"""Letters, words and character n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Texts are worked on in groups of about this many characters: bounds a task's memory. A longer text is one group.
GROUP_CHARS = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def groups(texts: Sequence[str]) -> Iterator[list[int]]:
    """Indices of texts in groups of about GROUP_CHARS; long texts come together."""
    group: list[int] = []
    total = 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if group and total + len(texts[i]) > GROUP_CHARS:
            yield group
            group, total = [], 0
        group.append(i)
        total += len(texts[i]) + 1
    if group:
        yield group


@dataclass
class Words:
    """Words (runs of letters) of a group of texts laid end to end, each text after one boundary."""

    letters: np.ndarray  # per character: lower-case letter or 0
    text_at: np.ndarray  # per text: place of its first character in ``letters``
    begin: np.ndarray  # per word: place of its first letter
    end: np.ndarray  # per word: place after its last letter
    text: np.ndarray  # per word: number of its text


def words_of(texts: Sequence[str]) -> Words:
    flat = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = lower_letters()[flat]
    is_letter = (letters != 0).view(np.int8)
    step = np.diff(is_letter)
    begin, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    text_at = np.cumsum([1, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(0, np.int64)
    return Words(letters, text_at, begin, end, np.searchsorted(text_at, begin, "right") - 1)


def ngram_buckets(words: Words, sizes: Sequence[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n of ``sizes`` (3 or more): per place, the bucket of the n-gram
    that begins there and whether it lies in one word. A word's n-grams may
    include the boundary (0) before its first and after its last letter; they
    begin from one place before the word."""
    a = words.letters.astype(np.uint64)
    inner = words.letters != 0
    h = a.copy()
    ok = np.ones(len(a), bool)
    for n in range(2, max(sizes) + 1):
        size = len(a) - n + 1
        if size <= 0:
            return
        h = h[:size] * _MULTIPLIER + a[n - 1:]
        ok = ok[:size]
        if n > 2:
            ok = ok & inner[n - 2:n - 2 + size]
        if n in sizes:
            x = (h ^ np.uint64(n)) * _MULTIPLIER
            yield (x >> np.uint64(64 - bits)).astype(np.int32), ok


def word_hashes(words: Words) -> np.ndarray:
    """Per word, a 64-bit hash of its letters."""
    if not len(words.begin):
        return np.zeros(0, np.uint64)
    h = words.letters.astype(np.uint64)
    place = np.arange(len(h), dtype=np.uint64)
    first = np.zeros(len(h), np.uint64)
    first[words.begin] = words.begin
    first = np.maximum.accumulate(first)
    # the sum over the letters of a mix of the letter and its place in the word
    x = (h + (place - first) * np.uint64(0x1F123BB5)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x[h == 0] = 0
    return np.add.reduceat(x, words.begin) * _MULTIPLIER


def times_in_text(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per word, how often it occurs in its text at the first of these places, 0 at the others."""
    kind = hashes ^ (words.text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    times = np.zeros(len(kind), np.float32)
    _, first, counts = np.unique(kind, return_index=True, return_counts=True)
    times[first] = counts
    return times


def per_word(words: Words, at_place: np.ndarray) -> np.ndarray:
    """Sum per word of values kept at the places where its n-grams begin."""
    if not len(words.begin):
        return np.zeros((0, *at_place.shape[1:]), at_place.dtype)
    return np.add.reduceat(at_place, words.begin - 1, axis=0)
