"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

#: Samples a row of a stored payload's frame, its rows, and pixels of a canvas or an image beyond which a file is a fault.
WIDTH, ROWS, PIXELS = 64, 64, 1 << 24
#: The palette of stored payloads: three bits of red, three of green, two of blue.
COLOURS = np.array([[(i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85] for i in range(256)], dtype=np.uint8)

FRAMES = "frame long, start_ms long, delay_ms long, disposal int, left int, top int, width int, height int, canvas_width int, canvas_height int, rgba binary, histogram array<int>, transparent long, fault string"


class GifError(ValueError):
    """The bytes are no GIF, or break off."""


@dataclass
class Image:
    """One image block: palette indexes (height x width) and how it is shown."""

    indexes: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None
    interlaced: bool = False


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    images: list[Image] = field(default_factory=list)
    fault: str | None = None


def _code_widths(clear: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: a code is as wide as the next free entry needs, 12 at most."""
    free = np.minimum(clear + 1 + np.arange(n), 4095)
    return np.frexp(free.astype(np.float64))[1]


def lzw_encode(data: bytes, bits: int) -> bytes:
    clear, last = 1 << bits, 4095 - (1 << bits) - 2
    runs: list[list[int]] = []
    if data:
        rest = iter(data)
        prefix, codes, table, free = next(rest), [], {}, clear + 2
        get = table.get
        for b in rest:
            key = prefix << 8 | b
            code = get(key)
            if code is None:
                codes.append(prefix)
                table[key] = free
                prefix = b
                if free == 4095:
                    runs.append(codes)
                    codes, free = [], clear + 2
                    table.clear()
                else:
                    free += 1
            else:
                prefix = code
        codes.append(prefix)
        runs.append(codes)
    else:
        runs.append([])
    codes_all, widths = [np.array([clear])], [np.array([bits + 1])]
    for i, run in enumerate(runs):
        run.append(clear if i < len(runs) - 1 else clear + 1)
        codes_all.append(np.array(run))
        widths.append(_code_widths(clear, len(run)))
    assert all(len(r) <= last + 2 for r in runs)
    value, width = np.concatenate(codes_all).astype("<u2"), np.concatenate(widths)
    spread = np.unpackbits(value.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(spread[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def _codes(data: bytes, bits: int) -> Iterator[tuple[list[int], bool]]:
    """The codes between clear codes, and whether the end code follows."""
    stream, clear, at = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"), 1 << bits, 0
    while True:
        run: list[np.ndarray] = []
        j, stop = 0, None
        while stop is None:
            width = min(12, (clear + 1 + j).bit_length())
            n = (1 << width) - clear - 1 - j if width < 12 else 1 << 16
            n = min(n, (len(stream) - at) // width)
            if n <= 0:
                yield [int(c) for r in run for c in r], True  # the stream breaks off: what came counts
                return
            got = stream[at : at + n * width].reshape(n, width) @ (1 << np.arange(width))
            ends = np.flatnonzero((got == clear) | (got == clear + 1))
            if len(ends):
                stop = int(got[ends[0]])
                n = int(ends[0]) + 1
                run.append(got[: n - 1])
            else:
                run.append(got)
            at += n * width
            j += n
        yield np.concatenate(run).tolist(), stop == clear + 1
        if stop == clear + 1:
            return


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """The first `size` samples of a code stream; fewer if it breaks off or names an entry that isn't there."""
    clear, out, have = 1 << bits, [], 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    for codes, _ in _codes(data, bits):
        if not codes:
            continue
        if codes[0] >= clear:
            break
        table, start = base.copy(), len(out)
        prev = table[codes[0]]
        out.append(prev)
        free = clear + 2
        for code in codes[1:]:
            if code < free:
                s = table[code]
            elif code == free < 4096:
                s = prev + prev[:1]
            else:
                return b"".join(out)[:size]
            if free < 4096:
                table.append(prev + s[:1])
                free += 1
            out.append(s)
            prev = s
        have += sum(map(len, out[start:]))
        if have >= size:
            break
    return b"".join(out)[:size]


def _passes(height: int) -> np.ndarray:
    """Rows of an interlaced image in the order stored."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def write(gif: Gif) -> bytes:
    """A GIF89a file with a 256-colour palette or smaller."""

    def table(palette):
        bits = max(1, int(len(palette) - 1).bit_length())
        full = np.zeros((1 << bits, 3), dtype=np.uint8)
        full[: len(palette)] = palette
        return bits, full.tobytes()

    out = [b"GIF89a", gif.width.to_bytes(2, "little"), gif.height.to_bytes(2, "little")]
    bits = 8
    if gif.palette is not None:
        bits, colours = table(gif.palette)
        out += [bytes([0xF0 | (bits - 1), 0, 0]), colours]
    else:
        out.append(bytes([0x70, 0, 0]))
    for im in gif.images:
        h, w = im.indexes.shape
        out.append(b"\x21\xf9\x04" + bytes([im.disposal << 2 | (im.transparent is not None)]) + im.delay.to_bytes(2, "little") + bytes([im.transparent or 0, 0]))
        flags, own = 0x40 * im.interlaced, bits
        colours = b""
        if im.palette is not None:
            own, colours = table(im.palette)
            flags |= 0x80 | (own - 1)
        out.append(b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (im.left, im.top, w, h)) + bytes([flags]) + colours)
        own = max(2, own)
        rows = im.indexes[_passes(h)] if im.interlaced else im.indexes
        codes = lzw_encode(np.ascontiguousarray(rows, dtype=np.uint8).tobytes(), own)
        out.append(bytes([own]))
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\x00")
    out.append(b"\x3b")
    return b"".join(out)


def read(data: bytes) -> Gif:
    """Parses a GIF87a or GIF89a file. A file that breaks off keeps the images before; `fault` says what was wrong."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF signature")
    u16 = lambda p: int.from_bytes(data[p : p + 2], "little")
    at = 13

    def colours(flags):
        nonlocal at
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("palette breaks off")
        at += 3 * n
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    def blocks():
        nonlocal at
        parts = []
        while True:
            if at >= len(data):
                raise GifError("blocks break off")
            n = data[at]
            if not n:
                at += 1
                return b"".join(parts)
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    gif = Gif(u16(6), u16(8), None)
    if gif.width * gif.height > PIXELS:
        raise GifError("canvas too large")
    control = (0, 0, None)
    try:
        if data[10] & 0x80:
            gif.palette = colours(data[10])
        while True:
            if at >= len(data):
                raise GifError("no trailer")
            kind = data[at]
            at += 1
            if kind == 0x3B:
                return gif
            if kind == 0x21:
                label = data[at] if at < len(data) else 0
                at += 1
                body = blocks()
                if label == 0xF9 and len(body) >= 4:
                    control = (body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
            elif kind == 0x2C:
                if at + 10 > len(data):
                    raise GifError("image breaks off")
                left, top, w, h, flags = u16(at), u16(at + 2), u16(at + 4), u16(at + 6), data[at + 8]
                at += 9
                if w * h > PIXELS:
                    raise GifError("image too large")
                own = colours(flags) if flags & 0x80 else None
                bits = data[at] if at < len(data) else 0
                at += 1
                if not 2 <= bits <= 8:
                    raise GifError("code size out of range")
                got = np.frombuffer(lzw_decode(blocks(), bits, w * h), np.uint8)
                if len(got) < w * h:
                    gif.fault = "samples are missing"
                full = np.zeros(w * h, dtype=np.uint8)
                full[: len(got)] = got
                full = full.reshape(h, w)
                if flags & 0x40:
                    rows = np.empty_like(full)
                    rows[_passes(h)] = full
                    full = rows
                gif.images.append(Image(full, left, top, control[0], control[1], control[2], own, bool(flags & 0x40)))
                control = (0, 0, None)
            else:
                raise GifError(f"unknown block {kind}")
    except GifError as e:
        gif.fault = str(e)
        return gif


def render(gif: Gif) -> Iterator[tuple[Image, np.ndarray]]:
    """Each image and the canvas (height x width x RGBA) as shown while it stands.

    Transparent samples leave the canvas as it is. Before the next image, disposal 2 clears the image's area and
    disposal 3 puts back what it covered; any other keeps it. A sample beyond its palette is black.
    """
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for im in gif.images:
        palette = im.palette if im.palette is not None else gif.palette if gif.palette is not None else grey
        full = np.zeros((256, 4), dtype=np.uint8)
        full[: len(palette), :3] = palette
        full[:, 3] = 255
        h, w = min(im.indexes.shape[0], gif.height - im.top), min(im.indexes.shape[1], gif.width - im.left)
        area = canvas[im.top : im.top + max(0, h), im.left : im.left + max(0, w)]
        before = area.copy() if im.disposal == 3 else None
        samples = im.indexes[: max(0, h), : max(0, w)]
        if im.transparent is None:
            area[...] = full[samples]
        else:
            shown = samples != im.transparent
            area[shown] = full[samples[shown]]
        yield im, canvas
        if im.disposal == 2:
            area[...] = 0
        elif before is not None:
            area[...] = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels in 64 colour bins: two bits each of red, green and blue."""
    seen = canvas[canvas[..., 3] > 0] if (canvas[..., 3] == 0).any() else canvas.reshape(-1, 4)
    return np.bincount((seen[:, 0] >> 6 << 4) | (seen[:, 1] >> 6 << 2) | (seen[:, 2] >> 6), minlength=64)


def frames(data: bytes | None) -> list[dict]:
    """The rows of FRAMES for one file. Null and empty: none. No GIF: one row with a fault and no frame number."""
    if not data:
        return []
    try:
        gif = read(data)
    except GifError as e:
        return [{"fault": str(e)}]
    out, clock = [], 0
    for i, (im, canvas) in enumerate(render(gif)):
        out.append({"frame": i, "start_ms": clock, "delay_ms": 10 * im.delay, "disposal": im.disposal, "left": im.left, "top": im.top, "width": im.indexes.shape[1], "height": im.indexes.shape[0], "canvas_width": gif.width, "canvas_height": gif.height, "rgba": canvas.tobytes(), "histogram": histogram(canvas).tolist(), "transparent": int((canvas[..., 3] == 0).sum())})
        clock += 10 * im.delay
    if gif.fault:
        out = [r | {"fault": gif.fault} for r in out] or [{"fault": gif.fault}]
    return out


def decode_frames(df: DataFrame, key: Sequence[str], column: str = "gif") -> DataFrame:
    """`key` columns and the frames of a binary GIF column, one row per frame (FRAMES); null and empty files give none.

    A key column that is called like one of FRAMES comes back with `key_` before its name, as often as it takes to be free. Files that are no GIF, or whose
    canvas or images have more than PIXELS pixels, give a row with a fault; repeated rows give their frames again.
    """
    own = [c.split()[0] for c in FRAMES.split(", ")]
    names: list[str] = []
    for c in key:
        name = c
        while name in own or name in names or name != c and name in key:
            name = f"key_{name}"
        names.append(name)
    file = "the_file"
    while file in names:
        file += "_"
    keyed = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(key, names, strict=True)), F.col(f"`{column}`").alias(file))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                rows = [[*r[:-1], *(f.get(c) for c in own)] for f in frames(r[-1])]
                if rows:  # a file's frames at a time
                    yield pd.DataFrame(rows, columns=[*names, *own])

    return keyed.mapInPandas(run, f"{kinds}, {FRAMES}")


def pack(payload: bytes) -> bytes:
    """Bytes as the 8-bit samples of a GIF: `WIDTH` a row, `ROWS` rows a frame. Length: a multiple of WIDTH.

    Disposal goes round 1, 2, 3 and delays with it. A sample that the canvas shows already is transparent, by an index
    that its frame doesn't use, so the payload can only be read from the rendered canvas.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    gif = Gif(WIDTH, min(len(samples), ROWS), COLOURS)
    canvas = np.full((gif.height, WIDTH), -1, np.int16)
    for i in range(0, len(samples), ROWS):
        frame = samples[i : i + ROWS]
        area, turn = canvas[: len(frame)], i // ROWS % 3
        used = np.bincount(frame.ravel(), minlength=256)
        clear, shown = int(used.argmin()), area == frame
        clear = clear if used[clear] == 0 and shown.any() else None
        gif.images.append(Image(frame if clear is None else np.where(shown, np.uint8(clear), frame), delay=4 + turn, disposal=1 + turn, transparent=clear))
        if turn < 2:  # 3 puts back what was there
            area[...] = frame if turn == 0 else -1
    return write(gif)


def unpack(media: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """What pack() stored, the summed histogram of its frames, their number and how many have transparent samples; read
    from the rendered canvas."""
    gif = read(media)
    if gif.fault:
        raise GifError(gif.fault)
    parts, bins, clear = [], np.zeros(64, dtype=np.int64), 0
    for im, canvas in render(gif):
        shown = canvas[: im.indexes.shape[0]]
        parts.append((shown[..., 0] // 36 << 5 | shown[..., 1] // 36 << 2 | shown[..., 2] // 85).astype(np.uint8).tobytes())
        bins += histogram(shown)
        clear += im.transparent is not None
    return b"".join(parts), bins, len(parts), clear


def _round_trip(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for part in slices(batch):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                media = pack(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
                back, bins, n, clear = unpack(media)
                feature = f"frames={n};transparent={clear};" + ",".join(f"{i}:{bins[i]}" for i in np.flatnonzero(bins))
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """Digest of each text stored as a GIF and read back. Null texts count as empty; every row of docs gives one, repeated
    ones and those of null ids too. feature: frames, those with transparent samples, and the colour histogram."""
    return docs.select("doc_id", "text").mapInArrow(C.tidy(_round_trip), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
