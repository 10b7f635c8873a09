"""Line dedup by an exact set-similarity join.

A line is the set of its words. Lines with equal sets share a 128-bit name; all but the first are repeats, and only first
lines go on. Each emits a row for every word of its prefix: its words in order of rarity, so many that any similar line
must share one of them. The rows travel packed, a binary for each slice and bucket of words. In a word's group a later
line is held against the earlier ones: length, position and a parity signature of what follows the word (together a bound on the symmetric difference)
leave few pairs, and those are verified on whole sets. Groups beyond GROUP rows are not compared: their lines come again
under pairs of words. All lines are judged as they came in; a removed line still removes later ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

#: Counters of the rarity order, blocks they are summed in, and rows up to which lists are broadcast.
SLOTS, BLOCKS, BROADCAST_ROWS = 1 << 20, 64, 1_000_000
#: Prefix rows of a bucket, rows of one word from which on pairs of words are taken, and rows packed at once.
BUCKET, GROUP, PACKED = 300_000, 8_192, 200_000
#: Candidates of a line and word that are verified at first; times as many at each further turn of the lines still open.
FIRST, TIMES = 32, 16
#: A prefix row as packed, column by column; the top bit of n marks the lines that look for an earlier one.
COLUMNS = (("word", "<u4"), ("pos", "<u4"), ("n", "<u4"), ("doc", "<i8"), ("at", "<i8"), ("low", "<u8"), ("high", "<u8"))
_OPEN = 1 << 31
_BYTES = sum(int(kind[2]) for _, kind in COLUMNS)


class Lines:
    """The lines of a slice: row and number of each, and their distinct words (as codes) with the line of each.

    Words stand by line, then by rarity (a level of 0 to 255 for each slot) if it is given, then by code. Lines of fewer
    than `least` words count as empty.
    """

    def __init__(self, column, rarity: np.ndarray | None = None, least: int = 0):
        raw, offsets = C.flat(column)
        starts, ends, _ = C.words(raw, offsets)
        feeds = np.flatnonzero(raw == 10)
        # a line of a row starts at the row's start and after each of its line feeds
        heads = np.concatenate([offsets[:-1], feeds + 1])
        owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1])
        by = np.lexsort((np.repeat([0, 1], [len(offsets) - 1, len(feeds)]), heads, owner))
        heads, self.row = heads[by], owner[by]
        self.top = np.searchsorted(self.row, np.arange(len(offsets)))
        self.number = np.arange(len(self.row)) - self.top[self.row]
        # of lines that start at one place all but the last are empty
        many = np.diff(np.append(np.searchsorted(starts, heads), len(starts)))
        line = np.repeat(np.arange(len(heads)), many)
        if least > 1:
            long = (many >= least)[line]
            line, starts, ends = line[long], starts[long], ends[long]
        codes = C.word_codes(raw, starts, ends)
        level = np.zeros(len(codes), np.uint64) if rarity is None else rarity[_slot(codes)].astype(np.uint64)
        order = None
        if len(heads) < 1 << 20:
            key = line.astype(np.uint64) << np.uint64(44) | level << np.uint64(36) | codes >> np.uint64(28)
            order = np.argsort(key)
            tie = np.flatnonzero(key[order[1:]] == key[order[:-1]])
            if (codes[order[tie]] != codes[order[tie + 1]]).any():
                order = None
        if order is None:
            order = np.lexsort((codes, level, line))
        line, codes = line[order], codes[order]
        once = np.append(True, (line[1:] != line[:-1]) | (codes[1:] != codes[:-1])) if len(line) else np.zeros(0, bool)
        self.line, self.codes = line[once], codes[once]
        self.size = np.bincount(self.line, minlength=len(self.row))
        self.stop = np.cumsum(self.size)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit sums over each line's distinct words: a name of 128 bits."""
        out = []
        for turn in (1, 2):
            total = np.append(np.uint64(0), np.cumsum(C.mix(self.codes * np.uint64(4 * turn + 1) + np.uint64(turn))))
            out.append(C.mix(total[self.stop] - total[self.stop - self.size] + self.size.astype(np.uint64)).view(np.int64))
        return out[0], out[1]

    def parity(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words (by number) the exclusive or of one of 128 bits a word, from the word to its line's end.

        The signatures of two such ends differ in no more bits than the ends in words.
        """
        bit = C.mix(self.codes + np.uint64(5))
        one, out = np.uint64(1) << (bit & np.uint64(63)), []
        for half in (bit & np.uint64(64) == 0, bit & np.uint64(64) != 0):
            upto = np.append(np.uint64(0), np.bitwise_xor.accumulate(np.where(half, one, np.uint64(0))))
            out.append(upto[self.stop[self.line[at]]] ^ upto[at])
        return out[0], out[1]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(44)).astype(np.int64)


def _places(part, lines):
    """doc_id and the place (part of the row, then number) of each line."""
    at = (part.column("part").to_numpy().astype(np.int64) << 32)[lines.row] | lines.number
    return part.column("doc_id").to_numpy()[lines.row], at


def _listed(part, lines, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose places a list column of their row holds, and the number of each in the column's values."""
    lists = part.column(name)
    size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    at = (values.field("at") if pa.types.is_struct(values.type) else values).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    own = np.flatnonzero(at >> 32 == part.column("part").to_numpy().astype(np.int64)[row])
    return lines.top[row[own]] + (at[own] & 0xFFFFFFFF), own


READ = "hi long, lo long, doc_id long, at long, block int, counts binary"


def _read(batches):
    """A row for each line with words, and at the end a row for each block of the counters of words."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            counts += np.bincount(_slot(lines.codes), minlength=SLOTS)
            doc, at = _places(part, lines)
            full = lines.size > 0
            n = int(full.sum())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[full]) for x in (*lines.names(), doc, at)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    if counts.any():
        blocks = [pa.Codec("zstd", 1).compress(x.tobytes(), asbytes=True) for x in counts.reshape(BLOCKS, -1)]
        none = pa.nulls(BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(blocks, pa.binary())], names)


def _add(batches):
    """The sums of the blocks of counters."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(pa.Codec("zstd").decompress(data, SLOTS // BLOCKS * 8), np.int64)
            sums[block] = sums[block] + counts if block in sums else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-size * percent // 100)


def _blob(columns: list[np.ndarray]) -> bytes:
    data = b"".join(x.tobytes() for x in columns)
    return len(columns[0]).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _pack(held: list[dict[str, np.ndarray]]):
    rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
    order = np.argsort(rows["bucket"], kind="stable")
    bucket = rows["bucket"][order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    stop = np.append(cut[1:], len(order))
    columns = [rows[c][order].astype(kind) for c, kind in COLUMNS]
    blobs = [_blob([x[a:b] for x in columns]) for a, b in zip(cut, stop, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def _prefixes(rarity, percent: int, buckets: int, hot=None, wanted=None, least: int = 0):
    """Packed prefix rows (bucket, rows) of first lines. hot: keys of words that are taken in pairs (only those come);
    wanted: keys of the groups that come, of lines of `least` words and more; then only `these` lines of a row look for an earlier one."""

    def entries(part):
        lines = Lines(part.column("text"), rarity.value, least)
        chosen = lines.size * (100 - percent) >= percent  # a shorter line resembles none but its equals
        gone, _ = _listed(part, lines, "gone")
        chosen[gone] = False
        seek = np.ones(len(lines.size), np.int64)
        if wanted is not None:
            seek[:] = 0
            seek[_listed(part, lines, "these")[0]] = 1
        doc, at = _places(part, lines)
        most = lines.size - _need(lines.size, percent)  # the last place of the prefix
        pos = np.arange(len(lines.line)) - (lines.stop - lines.size)[lines.line]
        head = np.flatnonzero(chosen[lines.line] & (pos <= most[lines.line]))
        code = lines.codes[head]
        if hot is not None:
            key = _key(code >> np.uint64(32), code.astype(np.uint32) % np.uint64(buckets))
            head = head[np.isin(key, hot.value)]
            # with each hot word the words after it, up to one place beyond the prefix
            last = np.minimum(most[lines.line[head]] + 1, lines.size[lines.line[head]] - 1)
            many = np.maximum(last - pos[head], 0)
            one = np.repeat(head, many)
            other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
            head, code = one, C.mix(lines.codes[one] * np.uint64(3) + lines.codes[other])
        line = lines.line[head]
        word, bucket = code >> np.uint64(32), (code.astype(np.uint32) % np.uint64(buckets)).astype(np.int64)
        if wanted is not None:
            keep = np.isin(_key(word, bucket), wanted.value)
            line, head, word, bucket = line[keep], head[keep], word[keep], bucket[keep]
        low, high = lines.parity(head)
        return {"bucket": bucket, "word": word, "pos": pos[head], "n": lines.size[line] | _OPEN * seek[line], "doc": doc[line], "at": at[line], "low": low, "high": high}

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch):
                got = entries(part)
                if len(got["word"]):
                    held.append(got)
                    n += len(got["word"])
                if n >= PACKED:
                    yield _pack(held)
                    held, n = [], 0
        if held:
            yield _pack(held)

    return run


def _key(word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bucket.astype(np.int64) << 32) | word.astype(np.int64)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {c: [] for c, _ in COLUMNS}
    for blob in blobs:
        n, at = int.from_bytes(blob[:4], "little"), 0
        blob = pa.Codec("zstd").decompress(blob[4:], n * _BYTES)
        for c, kind in COLUMNS:
            out[c].append(np.frombuffer(blob, kind, n, at))
            at += n * int(kind[2])
    return {c: np.concatenate(v) for c, v in out.items()}


def _in_order(word: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order by word, doc and place."""
    if not len(doc) or int(doc.max()) - int(doc.min()) >= 1 << 32:
        return np.lexsort((at, doc, word))
    key = word.astype(np.uint64) << np.uint64(32) | (doc - doc.min()).astype(np.uint64)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    some = order[tied]
    order[tied] = some[np.lexsort((at[some], key[some]))]
    return order


def _pairs(rows: dict[str, np.ndarray], skip: int, upto: int, percent: int):
    """Of rows by word, then doc and place: (x, y, more), rows of a line and of its skip-th to upto-th earlier candidates."""
    word = rows["word"]
    n, seek, pos = (rows["n"] & (_OPEN - 1)).astype(np.int64), rows["n"] >= _OPEN, rows["pos"].astype(np.int64)
    low, high = rows["low"], rows["high"]
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    group = np.repeat(start, np.diff(np.append(start, len(word))))
    live = np.flatnonzero((np.arange(len(word)) > group) & seek)
    seen = np.zeros(len(word), np.int32)
    e = 0
    while len(live):
        y = group[live] + e
        a, b = n[live], n[y]
        ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        ok &= np.minimum(a - pos[live], b - pos[y]) * (100 + percent) >= percent * (a + b)
        # under the first word of both, the words before it are in one line only
        ok &= (pos[live] + pos[y] + np.bitwise_count(low[live] ^ low[y]) + np.bitwise_count(high[live] ^ high[y])) * (100 + percent) <= (100 - percent) * (a + b)
        hit = live[ok]
        if len(hit):
            seen[hit] += 1
            now = seen[hit] > skip
            yield hit[now], y[ok][now], (seen[hit] == upto)[now]
        e += 1
        live = live[(live > group[live] + e) & (seen[live] < upto)]


PAIR = "x_doc long, x_at long, y_doc long, y_at long, more boolean, hot long"


def _candidates(skip: int, upto: int, percent: int, group: int | None):
    """From packed rows by bucket: candidate pairs of a line and an earlier one, and the keys of groups of over `group` rows."""
    names = [c.split()[0] for c in PAIR.split(", ")]

    def largest(rows, bucket):
        """Without the words that have too many rows, and the keys of those."""
        word, times = np.unique(rows["word"], return_counts=True)
        over = word[times > group]
        if not len(over):
            return rows, over
        keep = ~np.isin(rows["word"], over)
        return {c: v[keep] for c, v in rows.items()}, _key(over, np.full(len(over), bucket))

    def told(keys):
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, none.cast(pa.bool_()), pa.array(keys)], names)

    def close(bucket, blobs):
        rows = _unpack(blobs)
        if group is not None:
            rows, over = largest(rows, bucket)
            if len(over):
                yield told(over)
        if len(rows["word"]) < 2:
            return
        word, place, times = np.unique(rows["word"], return_inverse=True, return_counts=True)
        rows = {c: v[times[place] > 1] for c, v in rows.items()}  # a word of one line gives no pair
        order = _in_order(rows["word"], rows["doc"], rows["at"])
        rows = {c: v[order] for c, v in rows.items()}
        # a pair comes up under several words of the bucket
        found = [np.concatenate(c) for c in zip(*_pairs(rows, skip, upto, percent), strict=True)]
        if found and len(found[0]):
            x, y, more = found
            other = (rows["doc"][x] != rows["doc"][y]) | (rows["at"][x] != rows["at"][y])  # a repeated row's line is no other one
            x, y, more = x[other], y[other], more[other]
            columns = [rows["doc"][x], rows["at"][x], rows["doc"][y], rows["at"][y]]
            for i in range(0, len(x), 100_000):
                c = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(v[c]) for v in columns), pa.array(more[c]), pa.nulls(len(more[c]), pa.int64())], names)

    def run(batches):
        bucket, blobs, held = None, [], 0
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if b != bucket:
                    if blobs:
                        yield from close(bucket, blobs)
                    bucket, blobs, held = b, [], 0
                blobs.append(blob)
                held += int.from_bytes(blob[:4], "little")
                if group is not None and held >= 8 * BUCKET:  # a word of this bucket has very many rows: they go now
                    rows, over = largest(_unpack(blobs), bucket)
                    if len(over):
                        yield told(over)
                    blobs = [_blob([rows[c] for c, _ in COLUMNS])]
                    held = len(rows["word"]) // 2
        if blobs:
            yield from close(bucket, blobs)

    return run


SETS = "doc long, at long, y_doc long, y_at long, words array<long>"


def _sets(batches):
    """The words of the wanted lines; `wanted`: place, and the line each is to be held against (none: it is one of those)."""
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            line, own = _listed(part, lines, "wanted")
            if not len(line):
                continue
            doc, at = _places(part, lines)
            values = part.column("wanted").flatten().take(pa.array(own))
            size = lines.size[line]
            out = np.append(0, np.cumsum(size))
            codes = lines.codes[np.repeat((lines.stop - lines.size)[line] - out[:-1], size) + np.arange(out[-1])]
            for i in range(0, len(line), 20_000):
                c = slice(i, i + 20_000)
                lists = pa.ListArray.from_arrays(pa.array((out[i : i + 20_001] - out[i]).astype(np.int32)), pa.array(codes[out[i] : out[min(i + 20_000, len(line))]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[line[c]]), pa.array(at[line[c]]), values.field("y_doc")[c], values.field("y_at")[c], lists], ["doc", "at", "y_doc", "y_at", "words"])


def _with(rows: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """rows with the list of each doc_id; n: the lists' values, which decide whether they are broadcast."""
    return rows.join(F.broadcast(lists) if n <= BROADCAST_ROWS else lists, "doc_id", "left")


def _gone(rows: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id and place of every line whose words an earlier line has: one of a smaller doc_id, or above it in its row."""
    names = read.filter("hi is not null").select("hi", "lo", "doc_id", "at")
    first = C.materialise(names.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    told = names.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, ["hi", "lo"])
    # of a name's lines in its first document the least place stays; a row that comes twice has the same places
    own = told.filter("doc_id = first").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("least"), F.collect_set("at").alias("ats"))
    return told.filter("doc_id > first").select("doc_id", "at").union(own.select("doc_id", "least", F.explode("ats").alias("at")).filter("at > least").select("doc_id", "at"))


def _verified(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """x_doc and x_at of the pairs' later lines that resemble one of their earlier ones. Of these the earliest is tried first."""
    first = pairs.groupBy("x_doc", "x_at").agg(F.min("y_doc").alias("y_doc"), F.min_by("y_at", "y_doc").alias("y_at"))
    none = F.lit(None).cast("long")
    wanted = first.select(F.col("x_doc").alias("doc_id"), F.struct(F.col("x_at").alias("at"), "y_doc", "y_at").alias("w")).union(
        pairs.select("y_doc", "y_at").distinct().select("y_doc", F.struct(F.col("y_at").alias("at"), none.alias("y_doc"), none.alias("y_at")))
    )
    wanted = C.materialise(wanted)
    lists = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    sets = C.materialise(_with(rows, lists, wanted.count()).filter("wanted is not null").mapInArrow(C.tidy(_sets), SETS))
    # a repeated row gives its sets twice, which changes nothing
    later = sets.filter("y_doc is not null").select(F.col("doc").alias("x_doc"), F.col("at").alias("x_at"), "y_doc", "y_at", F.col("words").alias("x"))
    earlier = sets.filter("y_doc is null").select(F.col("doc").alias("y_doc"), F.col("at").alias("y_at"), F.col("words").alias("y"))

    def alike(both):
        both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.filter(f"100 * common >= {percent} * (size(x) + size(y) - common)").select("x_doc", "x_at")

    out = C.materialise(alike(later.join(earlier, ["y_doc", "y_at"])))
    rest = pairs.join(out, ["x_doc", "x_at"], "left_anti").select("x_doc", "x_at", "y_doc", "y_at")
    rest = rest.join(later.withColumnRenamed("y_doc", "d").withColumnRenamed("y_at", "a"), ["x_doc", "x_at"]).filter("d <> y_doc or a <> y_at")
    out = C.materialise(out.union(alike(rest.join(earlier, ["y_doc", "y_at"]))).distinct())
    C.discard(sets)
    C.discard(wanted)
    return out


def _levels(read: DataFrame) -> tuple[np.ndarray, int]:
    """How frequent each slot's words are, as 0 to 255, and the number of words."""
    counts = np.zeros((BLOCKS, SLOTS // BLOCKS), dtype=np.int64)
    for block, data in read.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(C.tidy(_add), "block int, counts binary").collect():  # BLOCKS rows
        counts[block] = np.frombuffer(data, np.int64)
    counts = counts.ravel()
    return np.minimum(6 * np.log2(counts + 1), 255).astype(np.uint8), int(counts.sum())


def matched_lines(rows: DataFrame, read: DataFrame, percent: int = 80) -> DataFrame:
    """x_doc and x_at of the first lines of their words that resemble an earlier, different line. rows: doc_id, part, text, gone."""
    spark = rows.sparkSession
    levels, total = _levels(read)
    rarity = spark.sparkContext.broadcast(levels)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (110 - percent) // 100 // BUCKET)
    out = None
    todo: list[tuple[int, int, dict]] = [(0, FIRST, {})]
    while todo:
        skip, upto, only = todo.pop()
        packed = (rows if "wanted" not in only else _with(rows, only["open"], only["n"])).mapInArrow(C.tidy(_prefixes(rarity, percent, buckets, only.get("hot"), only.get("wanted"), only.get("least", 0))), "bucket int, rows binary")
        found = C.materialise(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidy(_candidates(skip, upto, percent, None if only.get("hot") else GROUP)), PAIR))
        pairs = found.filter("hot is null").groupBy("x_doc", "x_at", "y_doc", "y_at").agg(F.max("more").alias("more"))
        pairs = C.materialise(pairs.join(out, ["x_doc", "x_at"], "left_anti") if out is not None else pairs)
        new = _verified(rows, pairs, percent)
        out = new if out is None else C.materialise(out.union(new))
        if not only.get("hot"):
            todo += [(0, upto, {"hot": keys}) for keys in _keys(found.filter("hot is not null").select(F.col("hot").alias("key")).distinct())]
        open_ = C.materialise(pairs.filter("more").select("x_doc", "x_at").distinct().join(out, ["x_doc", "x_at"], "left_anti"))
        if not open_.isEmpty():
            lists = open_.groupBy(F.col("x_doc").alias("doc_id")).agg(F.collect_set("x_at").alias("these"))
            again = {"hot": only.get("hot"), "open": lists, "n": open_.count()}
            keys = C.materialise(_groups(rows, rarity, percent, buckets, again))
            again["least"] = keys.agg(F.min("n")).first()[0] * percent // 100
            todo += [(upto, TIMES * upto, again | {"wanted": block}) for block in _keys(keys.select("key").distinct())]
        for x in (found, pairs):
            C.discard(x)
    return out


def _groups(rows: DataFrame, rarity, percent: int, buckets: int, only: dict) -> DataFrame:
    """The keys of the groups that the open lines are in, with the words of the shortest of these."""
    mine = _with(rows, only["open"], only["n"]).filter("these is not null").select("doc_id", "part", "text", "gone", "these")
    hot = only["hot"]

    def run(batches):
        for batch in _prefixes(rarity, percent, buckets, hot)(_those(batches)):
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                rows = _unpack([blob])
                word = np.unique(rows["word"])
                yield pa.RecordBatch.from_arrays([pa.array(_key(word, np.full(len(word), bucket))), pa.array(np.full(len(word), (rows["n"] & (_OPEN - 1)).min(), np.int64))], ["key", "n"])

    return mine.mapInArrow(C.tidy(run), "key long, n long")


def _those(batches):
    """Rows with all lines but `these` in `gone`."""
    for batch in batches:
        for part in slices(batch):
            lines = Lines(part.column("text"))
            keep, _ = _listed(part, lines, "these")
            rest = np.ones(len(lines.size), bool)
            rest[keep] = False
            _, at = _places(part, lines)
            count = np.append(0, np.cumsum(np.bincount(lines.row[rest], minlength=part.num_rows)))
            yield part.drop_columns(["gone", "these"]).append_column("gone", pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.array(at[rest])))


def _keys(keys: DataFrame):
    """Sorted broadcast arrays of BROADCAST_ROWS keys at most, however many there are."""
    keys = C.materialise(keys)
    blocks = -(-keys.count() // BROADCAST_ROWS)
    for i in range(blocks):
        own = keys.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).toPandas()["key"].to_numpy(np.int64)
        yield keys.sparkSession.sparkContext.broadcast(np.sort(own))
    C.discard(keys)


def _cut(batches):
    for batch in batches:
        for part in slices(batch):
            lists = part.column("gone")
            size, at = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
            upto, own = np.cumsum(size), part.column("part").to_numpy().astype(np.int64)
            texts, n, removed = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                gone = at[upto[i] - size[i] : upto[i]]
                gone = set((gone[gone >> 32 == own[i]] & 0xFFFFFFFF).tolist())
                lines = text.split("\n") if text else []
                texts.append("\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text)
                n.append(len(lines))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("others"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "others", "text", "n_lines", "n_removed"])


def _removals(rows: DataFrame, percent: int) -> DataFrame:
    """doc_id and the places of its lines that go."""
    read = C.materialise(rows.mapInArrow(C.tidy(_read), READ))
    gone = C.materialise(_gone(rows, read))
    listed = gone.groupBy("doc_id").agg(F.collect_list("at").alias("gone"))
    matched = matched_lines(_with(rows, listed, gone.count()), read, percent)
    C.discard(read)
    return C.materialise(gone.union(matched).groupBy("doc_id").agg(F.collect_set("at").alias("gone")))


def remove_lines(docs: DataFrame, percent: int = 80, report: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs (doc_id, text, other columns) with the lines removed that an earlier line equals or resembles; and the columns
    `report`: lines before, and lines removed (they replace columns of those names).

    Lines are cut at line feeds; earlier is by doc_id, then line. Resembling: Jaccard similarity of the word sets of at
    least `percent` hundredths. Equal sets are known by 128 bits; resemblance is verified word by word (64 bits a word).
    Lines without words stay. A null text stays null, an empty one empty, rows with a null doc_id stay whole, and rows of
    one doc_id and text are one document; other texts of one doc_id stand in the order of a hash. No rows: none.
    """
    docs = docs.drop(*report)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    part = F.expr("cast(pmod(xxhash64(text), 65536) as int)")
    # other columns travel in one struct, so that no name of theirs can clash
    base = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("others") if rest else F.lit(True).alias("others"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = base.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), part.alias("part"), "text")
    gone = _removals(rows, percent)
    named = _with(base.withColumn("part", F.coalesce(part, F.lit(0))), gone, gone.select(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0])
    kinds = f"doc_id {kind}, others {base.schema['others'].dataType.simpleString()}, text string, n_lines long, n_removed long"
    out = named.select("doc_id", "others", "text", "part", "gone").mapInArrow(C.tidy(_cut), kinds)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns), F.col("n_lines").alias(report[0]), F.col("n_removed").alias(report[1]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left (null: empty)."""
    return remove_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
