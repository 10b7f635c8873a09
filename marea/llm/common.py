"""Shared parts of the text operators: batch layout, symbol hashes, window minimisers and checkpoint folders."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_CODE = np.random.default_rng(20_24).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2, _ROLL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def lean(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch where the session has Spark's own number: texts are long, and a batch lies in memory twice."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share (spark.checkpoint.dir); a temporary one only where none is set, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="marea-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/marea/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files behind a frame made by materialise()."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """The function of batches, after whose last the worker gives free memory back: it may idle beside others for long."""

    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow array in one array, and the offsets of its rows; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    column = column.cast(pa.large_string()).cast(large) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(large)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else unchanged."""
    upper = (raw >= 65) & (raw <= 90)
    return np.where(upper, raw | 0x20, raw).astype(np.uint8)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (one more at the end)."""
    n = len(raw)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    first = inside[1:-1].copy()
    first &= change[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts[inside[1:-1][cuts]]] = True  # a row ends inside a word of the joined bytes
    last = inside[1:-1] & change[1:]
    last[cuts[inside[1:-1][cuts - 1]] - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of more bytes get their code from BLAKE2b, one by one; shorter ones eight bytes a step, side by side.
LONG = 128
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, its bytes mixed in eight at a time: no two words of one length up to 8 share one."""
    size = ends - starts
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))
    code = mix(size.astype(np.uint64) * _ROLL + np.uint64(2 * seed + 1))
    live, at, left = slice(None), starts, size
    while len(at):
        code[live] = mix(code[live] * _M1 ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = (left > 8) & (size[live] <= LONG)
        if not more.any():
            break
        live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        code[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return code


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for i in range(1, k):
        h *= _ROLL
        h += codes[i : i + n]
    return mix(h)


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, by doubling."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, out, done = _BYTE_CODE[raw], 1, None, 0
    while True:
        if k & width:
            if out is None:
                out = level.copy()
            else:
                m = len(level) - done
                out = out[:m] * np.uint64(pow(int(_ROLL), width, 2**64)) + level[done : done + m]
            done += width
        if done == k:
            return mix(out[:n])
        level = level[:-width] * np.uint64(pow(int(_ROLL), width, 2**64)) + level[width:]
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def anchors(hashes: np.ndarray, bounds: np.ndarray, k: int, length: int, longest: int = 64):
    """Cuts the windows of `length` symbols of each row into runs with one minimiser.

    hashes: of all runs of k symbols of the rows joined; bounds: first symbol of each row, one more at the end.
    Returns row, first window, windows and minimiser of each run. Equal windows have equal minimisers, wherever they
    stand, and each window is in exactly one run; a run has at most `longest` windows.
    """
    low = sliding_min(hashes, length - k + 1)
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    total = int(count.sum())
    if not total or not len(low):
        return none, none, none, np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(count)), count)
    before = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(total) - np.repeat(before[:-1] - bounds[:-1], count)
    value = low[at]
    new = np.empty(total, dtype=bool)
    new[0] = True
    np.not_equal(value[1:], value[:-1], out=new[1:])
    new[before[:-1][count > 0]] = True
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, total))
    if (size > longest).any():
        pieces = -(-size // longest)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head2 = np.repeat(head, pieces) + part * longest
        size = np.minimum(np.repeat(size, pieces) - part * longest, longest)
        head = head2
    return rows[head], at[head], size, value[head]


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs, by start."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def arrow_batches(table: pa.Table | pa.RecordBatch):
    return table.to_batches() if isinstance(table, pa.Table) else [table]


def null_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
