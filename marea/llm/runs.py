"""Periodic runs of words: stretches that repeat one sequence of words, found in linear time, and texts with them collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends. All runs of a text follow Kolpakov and Kucherov:

1. a suffix automaton of the words gives the LZ factorisation: each factor is the longest piece that started before;
2. runs that touch a border of two factors come from Main's algorithm: common prefixes and suffixes around the border, by
   the Z function, tell for each period how far it reaches;
3. a run strictly inside a factor is a copy of one inside the factor's earlier occurrence and is read off there.

Before that, a text is cut where no run can pass: every three neighbouring words of a run of exponent 4 or more occur at
least three times in it. What is left of most texts is nothing, and a cut can't shorten a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

#: Runs need this many periods, and this many words.
TIMES, LEAST = 4, 6
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def factors(text: list[int]) -> list[tuple[int, int, int]]:
    """Start, length and start of an earlier occurrence (-1: a new symbol) of each LZ factor; the occurrence may overlap it."""
    edges, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, begin, n = [], 0, len(text)
    while begin < n:
        state, end = 0, begin
        while end < n:
            to = edges[state][text[end]]
            if first[to] >= end:
                break
            state, end = to, end + 1
        size = end - begin
        out.append((begin, max(size, 1), first[state] - size + 1 if size else -1))
        begin += max(size, 1)
    return out


def common_prefixes(text: list[int]) -> list[int]:
    """The Z function: for each place, how far the text from there equals the text from its start."""
    n = len(text)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def find_runs(text: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all runs of at least `times` (2 or more) periods and `least` symbols, by start."""
    n = len(text)
    parts = [*factors(text), (n, 0, -1)]
    periods: dict[tuple[int, int], int] = {}
    ends: dict[int, list[int]] = {}

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in periods:
            periods[start, end] = period
            ends.setdefault(start, []).append(end)

    for i, (begin, size, source) in enumerate(parts):
        before, end = parts[i - 1][0] if i else begin, begin + size
        # a run that ends here starts less than a period before the last factor, else that factor would be longer
        longest = (end - before - 1) // (times - 1)
        if longest > 0:
            left = text[max(0, before - longest) : begin]
            right = text[begin:end]
            u, v = len(left), len(right)
            onward = common_prefixes([*right, -1, *left, *right])
            back = common_prefixes([*left[::-1], -1, *right[::-1], *left[::-1]])
            for q in range(1, longest + 1):
                for start, stop in (
                    (begin - back[u + 1 + v - q], begin + q + (onward[q] if q < v else 0)) if q <= v else (0, 0),  # a period lies behind the border
                    (begin - q - (back[q] if q < u else 0), begin + onward[v + 1 + u - q]) if q <= u else (0, 0),  # or before it
                ):
                    if stop - start >= max(times * q, least) and (start == 0 or text[start - 1] != text[start - 1 + q]) and (stop == n or text[stop] != text[stop - q]):
                        add(start, stop, q)
        if size > least:
            for start in range(source + 1, source + size - least):
                for stop in ends.get(start, ()):
                    if stop < source + size:
                        add(start + begin - source, stop + begin - source, periods[start, stop])
    return sorted((s, e - s, q) for (s, e), q in periods.items())


def candidates(codes: np.ndarray, owner: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of symbols outside which there is no run; owner: the row of each symbol, rising.

    Any three neighbours in a run of `times` periods occur at least times - 1 times in it. They are counted by hash within
    a stretch; a clash only leaves a stretch longer. Repeated until nothing more is cut off.
    """
    n = len(codes)
    least = max(least, 3)
    begin, end = (np.zeros(1, np.int64), np.full(1, n, np.int64)) if n else (np.zeros(0, np.int64),) * 2
    name = owner.astype(np.uint64)
    place = np.arange(n)
    while len(begin):
        code = codes[place].astype(np.uint64)
        m = len(place)
        if m < least:
            return []
        whole = (name[2:] == name[:-2]) & (place[2:] == place[:-2] + 2)
        key = C.mix(C.mix(C.mix(name[:-2] * C._ROLL + code[:-2]) * C._ROLL + code[1:-1]) * C._ROLL + code[2:])
        bits = max(10, int(4 * m).bit_length())
        key = (key >> np.uint64(64 - bits)).astype(np.int64)
        count = np.bincount(key[whole], minlength=1 << bits)
        good = np.zeros(m, bool)
        good[:-2] = whole & (count[key] >= times - 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2] + 2
        # neighbouring threes of one stretch lie in one row, as each lies in one and they overlap
        keep = last - first >= least
        first, last = first[keep], last[keep]
        size = last - first
        if size.sum() == m and len(first) == len(begin):
            begin, end = place[first], place[last - 1] + 1
            break
        upto = np.append(0, np.cumsum(size))
        at = np.repeat(first - upto[:-1], size) + np.arange(upto[-1])
        begin, end = place[first], place[last - 1] + 1
        place, name = place[at], np.repeat(np.arange(len(first), dtype=np.uint64), size)
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _collapse(order: Callable | None, times: int, least: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                raw, offsets = C.flat(part.column("text"))
                starts, ends, first = C.words(raw, offsets)
                size = ends - starts
                upto = np.append(0, np.cumsum(size))
                data = raw[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
                code = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
                count = np.diff(first)
                rows = len(count)
                word = np.arange(len(size))
                if order is not None:
                    for r, key in enumerate(part.column("doc_id").to_pylist()):
                        own = order(key, int(count[r]))
                        if own is not None:
                            word[first[r] : first[r + 1]] = first[r] + own
                code, owner = code[word], np.repeat(np.arange(rows), count)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
                gone = np.zeros(len(word) + 1, np.int64)
                for a, b in candidates(code, owner, times, least):
                    r = int(owner[a])
                    for s, length, q in find_runs(code[a:b].tolist(), times, least):
                        found[r].append((s + a - int(first[r]), length, q))
                        gone[a + s + q] += 1
                        gone[a + s + length] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                left = word[keep]
                size = ends[left] - starts[left] + 1
                upto = np.append(0, np.cumsum(size))
                joined = np.append(raw, np.uint8(32))[np.repeat(starts[left] - upto[:-1], size) + np.arange(upto[-1])]
                joined[upto[1:] - 1] = 32
                bound = upto[np.searchsorted(owner[keep], np.arange(rows + 1))]
                text = joined.tobytes()
                best = [max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if own else None for own in found]
                names = ("start", "length", "period")
                kind = pa.struct([(x, pa.int64()) for x in names])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(count.astype(np.int64)),
                        pa.array([[dict(zip(names, x, strict=True)) for x in own] for own in found], pa.list_(kind)),
                        pa.array([x and dict(zip(names, x, strict=True)) for x in best], kind),
                        pa.array([text[x : max(x, y - 1)] for x, y in zip(bound[:-1], bound[1:], strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    return run


def collapse(docs: DataFrame, times: int = TIMES, least: int = LEAST, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, all runs of each text by start and period, the strongest of them and the text with runs collapsed.

    A run keeps its first period, and the words that are left are joined by one space. strongest: the run of the greatest
    length per period, then the smallest start and period. order (doc_id, number of words): the places of the words to
    read instead of the text's own, or None. Null and empty texts have no words, no runs and an empty collapsed text; repeated
    rows are judged alike, a null doc_id stays null; other columns are not read. No rows: none. A stretch of a text that
    repeats takes some 600 bytes of memory a word in its task, the rest of it about 100.
    """
    C.lean(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(C.tidy(_collapse(order, times, least)), f"doc_id {kind}, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string")


def planted(doc_id, n: int) -> np.ndarray | None:
    """The digest's own word order: a tenth of the documents repeat a piece of themselves from some word on."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the strongest run and hashes of runs and collapsed text of every row, with a tenth of the texts made periodic."""
    found = collapse(docs, order=planted)
    best = F.col("strongest")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
