"""Substring dedup by a compressed FM-index per shard.

A shard's segments, as word numbers, are indexed by their Burrows-Wheeler transform in a wavelet matrix of packed bit
vectors. The documents' segments then stream through backward search, all side by side: each step prepends one word to
the current match, and a match that has reached the threshold first gives up its last word (the interval of the next
shorter prefix). The interval of each position names the documents that hold the match; those with an earlier document
are the reported windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marea.llm import common as C
from marea.llm.windows import Units, kept, removed_spans, slices


class Bits:
    """A bit vector in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[Bits] = []
        self.shift = max(1, int(sigma - 1).bit_length())
        for level in reversed(range(self.shift)):
            bit = (symbols >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros_like(at)
        for level, bits in zip(reversed(range(self.shift)), self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            at1, low1 = bits.rank(at), bits.rank(low)
            at = np.where(one, bits.zeros + at1, at - at1)
            low = np.where(one, bits.zeros + low1, low - low1)
        return at - low


def _suffixes(text: np.ndarray, markers: int) -> np.ndarray:
    """Order of the suffixes by prefix doubling; the end markers, all different, are the symbols under `markers`."""
    rank, step, n = text.astype(np.int64), 1, len(text)
    while True:
        key = rank * (n + markers + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of segments (arrays of word numbers 1.. joined, with their first words), each of an owner."""

    def __init__(self, words: np.ndarray, first: np.ndarray, owners: np.ndarray, longest: int):
        m, size = len(first) - 1, np.diff(first)
        n = len(words) + m
        ends = first[1:] + np.arange(m)
        marker = np.zeros(n, dtype=bool)
        marker[ends] = True
        text = np.empty(n, dtype=np.int64)
        text[ends] = np.arange(m)
        text[~marker] = words + m - 1
        order = _suffixes(text, m)
        plain = np.zeros(n, dtype=np.int64)
        plain[~marker] = words
        self.sigma = int(words.max(initial=0)) + 1
        self.bwt = WaveletMatrix(plain[order - 1], self.sigma)
        counts = np.bincount(plain, minlength=self.sigma)
        self.begin = np.cumsum(counts) - counts
        self.owner = np.repeat(owners, size + 1)[order]
        # where prefixes of longest - 1 words change: the interval a full match falls back to
        same, live = np.zeros(n, dtype=np.int32), np.arange(1, n)
        padded = np.append(text, np.arange(-longest, 0))
        for i in range(longest - 1):
            live = live[padded[order[live - 1] + i] == padded[order[live] + i]]
            same[live] += 1
        head = same < longest - 1
        self.heads = np.flatnonzero(head)
        self.run = np.cumsum(head) - 1
        self.stops = np.append(self.heads[1:], n)
        self.longest = longest

    def extend(self, low: np.ndarray, high: np.ndarray, word: np.ndarray):
        """Backward search: the intervals with one word in front."""
        both = self.bwt.rank(np.concatenate([word, word]), np.concatenate([low, high]))
        return self.begin[word] + both[: len(low)], self.begin[word] + both[len(low) :]

    def shorten(self, low: np.ndarray):
        """The interval of the first longest - 1 words at a place."""
        run = self.run[low]
        return self.heads[run], self.stops[run]

    def least_owner(self):
        """Sparse table of the smallest owner in intervals of 2^i places."""
        table = [self.owner]
        while 2 << (len(table) - 1) <= len(self.owner):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table


def _word_numbers(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word (with its space) of the segments as a number from 1, equal ones alike; first word of each segment."""
    raw, offsets = C.flat(segments)
    ends = np.flatnonzero(raw == 32) + 1
    starts = np.append(0, ends)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
    return tokens.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, np.searchsorted(starts, offsets)


def matching_windows(segments: pa.Array, owners: np.ndarray, units: Units) -> np.ndarray:
    """For each word of the joined segments: whether the window there also starts in a segment of a smaller owner."""
    words, first = _word_numbers(segments)
    hit = np.zeros(len(words), dtype=bool)
    if not len(words):
        return hit
    index = FMIndex(words, first, owners, units.length)
    table = index.least_owner()
    at, live = first[1:] - 1, np.flatnonzero(np.diff(first) > 0)
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(index.owner), dtype=np.int64)
    step = 0
    while len(live):
        step += 1
        lo, hi = low[live], high[live]
        if step > units.length:
            lo, hi = index.shorten(lo)
        lo, hi = index.extend(lo, hi, words[at[live]])
        low[live], high[live] = lo, hi
        if step >= units.length:
            level = np.log2(hi - lo).astype(np.int64)
            least = np.empty(len(lo), dtype=np.int64)
            for i in np.unique(level):
                w = level == i
                least[w] = np.minimum(table[i][lo[w]], table[i][hi[w] - (1 << i)])
            hit[at[live]] = least < owners[live]
        at[live] -= 1
        live = live[at[live] >= first[live]]
    return hit


def _digest(batches, length):
    for batch in batches:
        for part in slices(batch):
            raw, offsets = C.flat(part.column("text"))
            starts, ends, first = C.words(raw, offsets)
            removed, sha = [], []
            for i, lo, hi in kept(part, length, np.diff(first)):
                mine = slice(first[i], first[i + 1])
                s, e = starts[mine], ends[mine]
                removed.append(int((hi - lo).sum()))
                if len(lo):
                    edge = np.zeros(len(s) + 1, dtype=np.int32)
                    edge[lo] += 1
                    edge[hi] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    s, e = s[keep], e[keep]
                size = e - s + 1
                out = np.append(0, np.cumsum(size))
                text = np.append(raw, np.uint8(32))[np.repeat(s - out[:-1], size) + np.arange(out[-1])]
                text[out[1:] - 1] = 32
                sha.append(hashlib.sha256(text[:-1].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 13, k: int = 5) -> DataFrame:
    """Spans of words to remove: every word covered by a window of `length` words that also starts in a smaller doc_id.

    docs: doc_id, text. Words are runs of other than space, tab, line feed, vertical tab, form feed and carriage return.
    Returns doc_id, text, copy (nothing is new in it), part and spans (array of part, start, end in words; null: none). Null and short texts keep
    everything, and so do rows with a null doc_id. Repeated rows count as one document.
    """
    return removed_spans(docs, Units(length, k, False), matching_windows)


def digest(docs: DataFrame, length: int = 13, k: int = 5) -> DataFrame:
    """One row per document: n_words, n_removed and the SHA-256 of the kept words joined by spaces."""
    return remove_repeats(docs, length, k).mapInArrow(C.tidy(lambda batches: _digest(batches, length)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
