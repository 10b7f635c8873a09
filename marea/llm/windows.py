"""Repeated windows across documents, the plan shared by the FM-index and the suffix-array operator.

Every window of `length` symbols (bytes or words) is dealt to the shard of its minimiser, so equal windows of any two
documents meet in one shard and a shard never needs the rest of the corpus. The plan has five steps:

0. exact copies collapse to their smallest doc_id;
1. each document's minimisers, as (hash, doc_id), sorted by hash: those that two documents hold are shared;
2. documents with shared minimisers name their segments (runs of windows with one minimiser) by hash: equal ones collapse
   to the one of the smallest doc_id; where a minimiser has several that also agree on one side of it, their texts are
   called for;
3. a shard's texts go to the operator's own index, which says which windows also start in a smaller doc_id;
4. the removed spans meet their document again.

No step holds more of a key than its distinct segments: copies of a segment are answered as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C

#: Bytes of text handled at once, and of distinct segments that one index gets.
SLICE, SHARD = 1 << 20, 1 << 20
#: Bits of a minimiser's hash that its first, filtering pass leaves out, and those its shard's name leaves out.
KEPT, NAMED = 16, 32


@dataclass(frozen=True)
class Units:
    """What a window is made of: its length in symbols, the symbols of a minimiser, and bytes or words."""

    length: int
    k: int
    bytewise: bool

    def parse(self, column, hashed: bool = True):
        """Bytes, symbol starts in them, each row's first symbol (both with one more at the end) and hashes of k symbols."""
        raw, offsets = C.flat(column)
        if self.bytewise:
            return raw, np.arange(len(raw) + 1), offsets, C.byte_grams(raw, self.k) if hashed else None
        starts, ends, first = C.words(raw, offsets)
        hashes = C.grams(C.word_codes(raw, starts, ends), self.k) if hashed else None
        size = ends - starts + 1
        out = np.concatenate([[0], np.cumsum(size)])
        joined = np.append(raw, np.uint8(32))[np.repeat(starts - out[:-1], size) + np.arange(out[-1])]
        joined[out[1:] - 1] = 32
        return joined, out, first, hashes


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _minimisers(units: Units) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, _, first, hashes = units.parse(part.column("text"))
                row, _, _, low = C.anchors(hashes, first, units.k, units.length)
                if not len(row):
                    continue
                low = low >> np.uint64(KEPT)  # a false match only costs time
                order = np.lexsort((low, row))
                row, low = row[order], low[order]
                once = np.append(True, (row[1:] != row[:-1]) | (low[1:] != low[:-1]))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row[once]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(low[once].view(np.int64)), pa.array(ids)], ["h", "doc_id"])

    return run


def _shared(batches):
    """From distinct rows by h: those whose h another row has, so another document. The last row waits for the next batch."""
    h, d, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        h, d = np.append(h, batch.column(0).to_numpy()), np.append(d, batch.column(1).to_numpy())
        if len(h) < 2:
            continue
        same = h[1:] == h[:-1]
        give = np.append(before == h[0], same[:-1]) | same
        before = h[-2]
        if give.any():
            yield pa.RecordBatch.from_arrays([pa.array(d[:-1][give]), pa.array(h[:-1][give])], ["doc_id", "h"])
        h, d = h[-1:], d[-1:]
    if len(h) and before == h[0]:
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(h)], ["doc_id", "h"])


def _sides(units: Units, raw, place, hashes, at, size, value):
    """Hashes of what stands left and right of each run's minimiser, with it: any window of the run holds one of both.

    0: the run has no window with that side; a run with several minimisers of its value has -1 on both.
    """
    reach, wide = (units.length - units.k) // 2, units.length - units.k
    found, times = np.full(len(at), -1), np.zeros(len(at), np.int32)
    last = at + size - 1 + wide
    for o in range(int(size.max()) + wide):
        here = np.minimum(at + o, last)
        same = (hashes[here] == value) & (at + o <= last)
        found[same & (found < 0)] = here[same & (found < 0)]
        times += same
    end = at + size - 1 + units.length
    out = []
    for lo, hi in ((found - reach, found + units.k), (found, found + units.k + reach)):
        ok = (lo >= at) & (hi <= end)
        code = np.zeros(len(at), np.int32)
        code[ok] = (C.word_codes(raw, place[lo[ok]], place[hi[ok]]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        out.append(np.where(times > 1, np.int32(-1), code))
    return out


def _names(units: Units) -> Callable:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                raw, place, first, hashes = units.parse(part.column("text"))
                row, at, size, low = C.anchors(hashes, first, units.k, units.length)
                wanted, bounds = part.column("hs").flatten().to_numpy(zero_copy_only=False), part.column("hs").value_lengths().to_numpy()
                short, value = (low >> np.uint64(KEPT)).view(np.int64), low
                low = (low >> np.uint64(NAMED)).astype(np.uint32).view(np.int32)
                keep = np.zeros(len(row), dtype=bool)
                ends = np.cumsum(bounds)
                cut = np.searchsorted(row, np.arange(len(bounds) + 1))
                for i in range(len(bounds)):
                    keep[cut[i] : cut[i + 1]] = np.isin(short[cut[i] : cut[i + 1]], wanted[ends[i] - bounds[i] : ends[i]])
                row, at, size, low, value = row[keep], at[keep], size[keep], low[keep], value[keep]
                if not len(row):
                    continue
                left, right = _sides(units, raw, place, hashes, at, size, value)
                lo, hi = place[at], place[at + size + units.length - 1]
                name = C.word_codes(raw, lo, hi).view(np.int64)
                ids, copies = part.column("doc_id").to_numpy()[row], part.column("part").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(name), pa.array(ids), pa.array(copies), pa.array((at - first[row]).astype(np.int32)), pa.array((size + units.length - 1).astype(np.int16)), pa.array(left), pa.array(right)], ["h", "name", "doc_id", "part", "at", "n", "left", "right"])

    return run


#: Kinds of rows after the names have met: a span to remove, and a segment whose text its group has to compare.
SPAN, WANTED = 0, 1


def _compare_names(batches):
    """Names stand for segments: 64 bits of their own and 32 of their minimiser.

    From rows by (h, name, doc_id): spans of all but a name's smallest document, and what groups of several names need."""

    def out(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows["doc_id"]), kind, np.int8)), *(pa.array(rows[c]) for c in ("doc_id", "part", "at", "n", "h"))], ["kind", "doc_id", "part", "at", "n", "h"])

    def settle(rows, last):
        """Rows of whole groups, and of the group that may go on: those of its names' first documents."""
        h, name, doc = rows["h"], rows["name"], rows["doc_id"]
        new = np.append(True, (h[1:] != h[:-1]) | (name[1:] != name[:-1]))
        owner = doc[new][np.cumsum(new) - 1]
        own = doc == owner
        group = np.append(True, h[1:] != h[:-1])
        index = np.cumsum(group) - 1
        several = np.bincount(index, weights=new) > 1
        # of a group's names, those that share a side with another one
        one = np.flatnonzero(new & several[index])
        alike = np.zeros(len(h), bool)
        for side in ("left", "right"):
            v = rows[side][one]
            by = np.lexsort((v, h[one]))
            same = (h[one][by][1:] == h[one][by][:-1]) & (v[by][1:] == v[by][:-1]) & (v[by][1:] != 0)
            alike[one[by[1:][same]]] = alike[one[by[:-1][same]]] = True
        loose = np.zeros(len(several), bool)
        loose[index[one][rows["left"][one] == -1]] = True
        wanted = (alike[np.flatnonzero(new)] | loose[index[new]])[np.cumsum(new) - 1]
        open_ = index == index[-1] if not last else np.zeros(len(h), bool)
        return {c: v[~own] for c, v in rows.items()}, {c: v[own & several[index] & wanted & ~open_] for c, v in rows.items()}, {c: v[own & open_] for c, v in rows.items()}

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if held:
            rows = {c: np.append(held[c], v) for c, v in rows.items()}
        if not len(rows["h"]):
            continue
        spans, wanted, held = settle(rows, False)
        yield out(spans, SPAN)
        yield out(wanted, WANTED)
    if held and len(held["h"]):
        yield out(settle(held, True)[1], WANTED)


def _segments(units: Units) -> Callable:
    """The texts of the wanted segments of each document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                raw, place, first, _ = units.parse(part.column("text"), False)
                lists = part.column("wanted")
                size, flat = lists.value_lengths().to_numpy(), lists.flatten()
                row = np.repeat(np.arange(len(size)), size)
                h, of, at, n = (flat.field(i).to_numpy() for i in range(4))
                mine = of == part.column("part").to_numpy()[row]
                row, h, at, n = row[mine], h[mine], at[mine], n[mine]
                ids, copies = part.column("doc_id").to_numpy()[row], part.column("part").to_numpy()[row]
                for i in range(0, len(row), 20_000):
                    cut = slice(i, i + 20_000)
                    start = first[row[cut]] + at[cut]
                    lo, size = place[start], place[start + n[cut]] - place[start]
                    out = np.concatenate([[0], np.cumsum(size)])
                    data = raw[np.repeat(lo - out[:-1], size) + np.arange(out[-1])]
                    segment = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[cut]), pa.array(ids[cut]), pa.array(copies[cut]), pa.array(at[cut]), segment], ["h", "doc_id", "part", "at", "segment"])

    return run


def _spans(units: Units, solve: Callable) -> Callable:
    """solve(segments, owners, group) of distinct segments: for each symbol start, whether its window starts in a smaller doc_id too."""

    def out(doc, part, start, end):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(part), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "part", "start", "end"])

    def symbols(column):
        raw, offsets = C.flat(column)
        if units.bytewise:
            return offsets
        return np.append(0, np.cumsum(raw == 32))[offsets]

    def compact(rows: pa.Table):
        """The rows of each segment's smallest document, numbered by segment, and the spans of all others."""
        h = rows.column("h").to_numpy()
        # equal segments have equal minimisers, so the bytes alone name the group's segment
        names = rows.column("segment").combine_chunks().dictionary_encode()
        names = names.indices.to_numpy() if not isinstance(names, pa.ChunkedArray) else names.combine_chunks().indices.to_numpy()
        doc = rows.column("doc_id").to_numpy()
        owner = np.full(names.max() + 1 if len(names) else 0, np.iinfo(np.int64).max)
        np.minimum.at(owner, names, doc)
        own = doc == owner[names]
        others = rows.filter(pa.array(~own))
        spans = None
        if others.num_rows:
            n = np.diff(symbols(others.column("segment")))
            at = others.column("at").to_numpy()
            spans = out(others.column("doc_id").to_numpy(), others.column("part").to_numpy(), at, at + n)
        return rows.filter(pa.array(own)), h, spans

    def decide(rows: pa.Table):
        rows, _, spans = compact(rows)
        if spans is not None:
            yield spans
        h, doc = rows.column("h").to_numpy(), rows.column("doc_id").to_numpy()
        names = rows.column("segment").combine_chunks().dictionary_encode()
        code, distinct = names.indices.to_numpy(), names.dictionary
        _, one = np.unique(code, return_index=True)
        group, size = np.unique(h[one], return_inverse=True), None
        size = np.bincount(group[1])
        several = size[group[1]] > 1  # a segment alone in its group has nothing to be compared with
        if not several.any():
            return
        chosen = np.flatnonzero(several)
        picked = distinct.take(pa.array(chosen))
        hit = solve(picked, doc[one][chosen], units)
        first = symbols(picked)
        new = np.full(len(one), -1)
        new[chosen] = np.arange(len(chosen))
        # runs of hit windows, as spans of symbols
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seg = np.searchsorted(first, lo, side="right") - 1
        lo, hi = lo - first[seg], hi - first[seg] + units.length - 1
        row = np.flatnonzero(new[code] >= 0)
        row = row[np.argsort(new[code[row]], kind="stable")]
        start = np.searchsorted(new[code[row]], seg)
        many = np.searchsorted(new[code[row]], seg, side="right") - start
        take = row[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        if len(take):
            at = rows.column("at").to_numpy()[take]
            yield out(doc[take], rows.column("part").to_numpy()[take], at + np.repeat(lo, many), at + np.repeat(hi, many))

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        held, limit = 0, SHARD
        for batch in batches:
            waiting.append(batch)
            held += batch.nbytes
            if held < 2 * limit:
                continue
            rows, h, spans = compact(pa.Table.from_batches(waiting))
            if spans is not None:
                yield spans
            h = rows.column("h").to_numpy()
            full = int(np.searchsorted(h, h[-1])) if rows.nbytes >= SHARD else 0
            at = 0
            while at < full:  # shards end where a group ends
                upto = full if rows.slice(at, full - at).nbytes <= 2 * SHARD else int(np.searchsorted(h, h[min(full - 1, at + max(1, int((full - at) * SHARD / rows.slice(at, full - at).nbytes)))], side="right"))
                upto = min(upto, full)
                yield from decide(rows.slice(at, upto - at))
                at = upto
            rows = rows.slice(full).combine_chunks()
            waiting, held = rows.to_batches(), rows.nbytes
            limit = max(SHARD, 2 * held)
        if waiting:
            yield from decide(pa.Table.from_batches(waiting))

    return run


def removed_spans(docs: DataFrame, units: Units, solve: Callable) -> DataFrame:
    """`docs` (doc_id, text) with `copy`, `part` and `spans` (array of part, start, end): symbols covered by repeated windows.

    A copy's text is that of a smaller doc_id; each of its windows is repeated, and `spans` leaves it out. Rows with null ids and null or short texts keep everything. Rows with one doc_id are one document to the rest of
    the corpus; `part` (a hash of the text) tells their spans apart.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part = F.expr("cast(pmod(xxhash64(text), 65536) as int)")
    nameless = base.filter("doc_id is null").select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("copy"), F.lit(None).cast("array<struct<part: int, start: int, end: int>>").alias("spans"))
    base = base.filter("doc_id is not null")
    texts = base.withColumn("part", part).repartition("doc_id")  # read again and again, shuffled once
    # exact copies are answered at once: only the smallest doc_id of a text takes part in the search
    first = base.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.first(part).alias("part"))
    originals = first.groupBy("doc_id").agg(F.collect_list("part").alias("parts"))
    told = texts.join(originals, "doc_id", "left").withColumn("copy", ~F.coalesce(F.array_contains("parts", F.col("part")), F.lit(False))).drop("parts")
    single = told.filter("not copy").drop("copy")
    low = single.select("doc_id", "text").mapInArrow(C.tidy(_minimisers(units)), "h long, doc_id long")
    shared = low.repartition("h").sortWithinPartitions("h").mapInArrow(C.tidy(_shared), "doc_id long, h long")
    per_doc = shared.groupBy("doc_id").agg(F.collect_list("h").alias("hs"))
    names = single.join(per_doc, "doc_id").select("doc_id", "part", "text", "hs").mapInArrow(C.tidy(_names(units)), "h int, name long, doc_id long, part int, at int, n short, left int, right int")
    met = names.repartition("h").sortWithinPartitions("h", "name", "doc_id").mapInArrow(C.tidy(_compare_names), "kind byte, doc_id long, part int, at int, n short, h int").repartition("doc_id")
    wanted = met.filter(f"kind = {WANTED}").groupBy("doc_id").agg(F.collect_list(F.struct("h", "part", "at", "n")).alias("wanted"))
    segments = single.join(wanted, "doc_id").select("doc_id", "part", "text", "wanted").mapInArrow(C.tidy(_segments(units)), "h int, doc_id long, part int, at int, segment binary")
    found = segments.repartition("h").sortWithinPartitions("h").mapInArrow(C.tidy(_spans(units, solve)), "doc_id long, part int, start int, end int")
    copied = met.filter(f"kind = {SPAN}").select("doc_id", F.struct("part", F.col("at").alias("start"), F.expr("at + n").alias("end")).alias("span"))
    spans = copied.union(found.select("doc_id", F.struct("part", "start", "end"))).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    return told.join(spans, "doc_id", "left").select("doc_id", "text", "part", "copy", "spans").union(nameless)


def kept(batch: pa.RecordBatch, length: int, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row its index and its merged spans; a copy with a window (symbols: each row's length) loses everything."""
    copy = batch.column("copy").to_numpy(zero_copy_only=False)
    lists = batch.column("spans")
    flat = lists.flatten()
    part, start, end = (flat.field(i).to_numpy() for i in range(3))
    size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, own = np.cumsum(size), batch.column("part").to_numpy()
    for i in range(len(size)):
        if copy[i]:
            whole = symbols[i : i + 1] * (symbols[i] >= length)
            yield i, whole[whole > 0] * 0, whole[whole > 0]
            continue
        mine = slice(upto[i] - size[i], upto[i])
        ok = part[mine] == own[i]
        yield i, *C.merge_spans(start[mine][ok], end[mine][ok])
