"""Substring dedup by a suffix array of many documents, built column by column.

A shard's segments are taken symbol by symbol from their ends: each round inserts one suffix per segment into the
collection's Burrows-Wheeler transform, finds its place from the transform so far (C and rank), and sets the common
prefixes with its two neighbours. The transform, the suffix pointers and the common prefixes are sequential files,
each round read in order and written anew; small ones stay in memory.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marea.llm import common as C
from marea.llm.windows import Units, kept, removed_spans, slices

#: Elements above which a round's file leaves memory, and elements read or written at once.
IN_MEMORY, CHUNK = 1 << 25, 1 << 18


def _file(n: int, kind) -> np.ndarray:
    if n <= IN_MEMORY:
        return np.empty(n, dtype=kind)
    with tempfile.TemporaryFile() as f:  # unnamed: gone with the task, however it ends
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, dtype=kind, mode="r+", shape=(n,))


def _insert(old: list[np.ndarray], at: np.ndarray, new: list[np.ndarray]) -> list[np.ndarray]:
    """Writes the next files in order: `new` at the (increasing, final) places `at`, the old elements in between."""
    n, m = len(old[0]), len(at)
    out = [_file(n + m, a.dtype) for a in old]
    done = used = 0
    for start in range(0, n + m, CHUNK):
        stop = min(start + CHUNK, n + m)
        upto = int(np.searchsorted(at, stop))
        free = np.ones(stop - start, dtype=bool)
        free[at[used:upto] - start] = False
        take = stop - start - (upto - used)
        for target, a, b in zip(out, old, new, strict=True):
            piece = np.empty(stop - start, dtype=a.dtype)
            piece[free] = a[done : done + take]
            piece[~free] = b[used:upto]
            target[start:stop] = piece
        done, used = done + take, upto
    return out


def _ranks(bwt: np.ndarray, sigma: int, places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the symbol at each (increasing) place stands before it, and how often every symbol stands at all."""
    out, totals, used = np.empty(len(places), dtype=np.int64), np.zeros(sigma, dtype=np.int64), 0
    for start in range(0, len(bwt), CHUNK):
        piece = np.asarray(bwt[start : start + CHUNK])
        upto = int(np.searchsorted(places, start + len(piece)))
        counts = np.bincount(piece, minlength=sigma)
        if upto > used:
            order = np.argsort(piece, kind="stable")
            turn = np.empty(len(piece), dtype=np.int32)
            turn[order] = np.arange(len(piece), dtype=np.int32)
            c = symbols[used:upto]
            out[used:upto] = turn[places[used:upto] - start] - (np.cumsum(counts) - counts)[c] + totals[c]
        totals += counts
        used = upto
    return out, totals


def _common(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, 8 symbols at a time; left: symbols up to a suffix's end."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = words[x] ^ words[y]
        # symbols before the lowest byte that differs
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[live] += same
        live = live[(same == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


def build(segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix pointers (into the joined segments), common prefixes with the suffix before, and segment of each pointer."""
    raw, offsets = C.flat(segments)
    m, size = len(offsets) - 1, np.diff(offsets)
    alphabet = np.unique(raw)
    code = np.zeros(256, dtype=np.uint8)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    text, sigma = code[raw], len(alphabet) + 1
    left = np.repeat(offsets[1:], size) - np.arange(len(raw))
    left = np.append(left, 0)
    padded = np.append(text, np.zeros(16, np.uint8))
    words = np.zeros(len(raw) + 8, dtype=np.uint64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    # round 0: the empty suffixes, in the order of the segments; each is preceded by its segment's last symbol
    ends = offsets[1:]
    bwt = np.where(size > 0, np.append(text, 0)[np.maximum(ends - 1, 0)], 0).astype(np.uint8)
    pointers, common = np.full(m, len(raw), dtype=np.int32), np.zeros(m, dtype=np.int32)
    live, place = np.flatnonzero(size > 0), np.flatnonzero(size > 0)
    length = 0
    while len(live):
        length += 1
        start = ends[live] - length
        symbol = text[start]
        rank, totals = _ranks(bwt, sigma, place, symbol)
        totals[0] = 0
        place = m + (np.cumsum(totals) - totals)[symbol] + rank
        order = np.argsort(place, kind="stable")
        live, place, start = live[order], place[order], start[order]
        before = np.where(size[live] > length, text[np.maximum(start - 1, 0)], 0).astype(np.uint8)
        bwt, pointers, common = _insert([bwt, pointers, common], place, [before, start.astype(np.int32), np.zeros(len(start), np.int32)])
        has = place > 0
        common[place[has]] = _common(words, left, pointers[place[has] - 1], start[has])
        has = (place + 1 < len(pointers)) & (np.append(np.diff(place), 0) != 1)
        common[place[has] + 1] = _common(words, left, start[has], pointers[np.minimum(place[has] + 1, len(pointers) - 1)])
        more = size[live] > length
        live, place = live[more], place[more]
    return pointers[m:], common[m:], np.repeat(np.arange(m), size)


def earlier_windows(segments: pa.Array, owners: np.ndarray, units: Units) -> np.ndarray:
    """For each symbol of the joined segments: whether the window there also starts in a segment of a smaller owner."""
    pointers, common, segment = build(segments)
    hit = np.zeros(len(pointers), dtype=bool)
    if not len(pointers):
        return hit
    head = np.append(True, common[1:] < units.length)
    starts = np.flatnonzero(head)
    owner = owners[segment[pointers]]
    least = np.minimum.reduceat(owner, starts)
    # a run of one suffix, or of suffixes shorter than a window, has no smaller owner: its least is its own
    hit[pointers] = least[np.cumsum(head) - 1] < owner
    return hit


def _digest(batches, length):
    for batch in batches:
        for part in slices(batch):
            raw, offsets = C.flat(part.column("text"))
            removed, spans, sha = [], [], []
            for i, lo, hi in kept(part, length, np.diff(offsets)):
                text = raw[offsets[i] : offsets[i + 1]]
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                if len(lo):
                    mask = np.ones(len(text) + 1, dtype=np.int8)
                    mask[lo] -= 1
                    edge = np.zeros(len(text) + 1, dtype=np.int32)
                    edge[lo] += 1
                    edge[hi] -= 1
                    text = text[np.cumsum(edge[:-1]) == 0]
                sha.append(hashlib.sha256(text.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 16) -> DataFrame:
    """Spans of bytes to remove: every byte covered by a `length`-byte string that also starts in a smaller doc_id.

    docs: doc_id, text. Returns doc_id, text, copy (nothing is new in it), part and spans (array of part, start, end; null: none). Null and short
    texts keep everything, and so do rows with a null doc_id. Repeated rows count as one document.
    """
    return removed_spans(docs, Units(length, k, True), earlier_windows)


def digest(docs: DataFrame, length: int = 50, k: int = 16) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    return remove_repeats(docs, length, k).mapInArrow(C.tidy(lambda batches: _digest(batches, length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
