"""Words and word n-grams of a block of texts as 64-bit hashes, with array operations only.

A word is ``[^\\x20\\x09-\\x0D]+``.  Its hash sums one random-looking value for each byte at its
place in the word, then mixes; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


#: Places of a word with a table of byte values of their own; bytes farther on are mixed with their place.
PLACES = 64
PLACE_VALUES = _numbers(PLACES * 256, 1 << 20)
GRAM_FACTORS = _numbers(64, 8192) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes ``text[start:end]``.

    A sum of powers modulo 2^64 would map whole families of long words to one value, whatever
    the base; here each place has its own table, so only chance makes two sums equal.
    """
    sizes = ends - starts
    upto = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=upto[1:])
    every = np.arange(upto[-1])
    place = every - np.repeat(upto[:-1], sizes)
    value = PLACE_VALUES[((place & (PLACES - 1)) << 8) | text[every + np.repeat(starts - upto[:-1], sizes)]]
    with np.errstate(over="ignore"):
        if sizes.max(initial=0) > PLACES:
            deep = np.flatnonzero(place >= PLACES)
            value[deep] = mix(value[deep] + (place[deep] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        return mix((sums[upto[1:]] - sums[upto[:-1]]) ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    """Words of a run of texts; ``first[d]:first[d + 1]`` are those of text ``d``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``; starts count from the first text's start."""
    text = data[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    if lower:
        text = LOWERED[text]
    inside = ~IS_SPACE[text]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = bounds[:-1][np.diff(bounds) > 0]
    begins[filled] = inside[filled]
    filled = bounds[1:][np.diff(bounds) > 0] - 1
    closes[filled] = inside[filled]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    hashes = span_hashes(text, starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (across texts too; the caller drops those)."""
    size = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size, np.uint64)
        for j in range(n):
            total += hashes[j:j + size] * GRAM_FACTORS[j]
        return mix(total + np.uint64(n))


def window_starts(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``n`` words of one text begin, and the text of each."""
    text = words.text_of()
    fits = np.arange(len(text)) + n <= words.first[text + 1]
    return np.flatnonzero(fits), text[fits]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles per text, as (text, hash) sorted by both.

    A text of fewer words gives its whole sequence as one shingle; one without words none.
    """
    at, text = window_starts(words, n)
    grams = gram_hashes(words.hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        with np.errstate(over="ignore"):
            whole = counts[short].astype(np.uint64)
            for j in range(n - 1):
                has = counts[short] > j
                whole[has] += words.hashes[words.first[short[has]] + j] * GRAM_FACTORS[j]
        text, grams = np.concatenate([text, short]), np.concatenate([grams, mix(whole)])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    return text[fresh], grams[fresh]


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)
