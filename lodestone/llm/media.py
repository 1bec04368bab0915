"""Media columns: PNG decoding with checksum tests and numpy unfiltering, and perceptual hashes as binary.

The hash is the sign, against their median, of the 64 lowest frequencies of a cosine transform of the
picture's brightness at 32 x 32: 8 bytes, close in Hamming distance for pictures that look alike.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import in_arrow

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIDE, LOW = 32, 8
#: (first column, first row, step across, step down) of a plain picture's only pass and of the seven of an interlaced one.
PLAIN = ((0, 0, 1, 1),)
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Deflate makes no byte into more than so many; a header that promises more is not believed.
MOST_DEFLATED = 1032
#: Bytes of lines that are decoded at once in a picture that is too large to be held, and pixels of a line.
BAND_BYTES, BAND_PIXELS = 1 << 22, 1 << 16


class Bad(ValueError):
    """A picture that can't be decoded; its text is the status."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise Bad("no_png")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise Bad("truncated")
        (size,) = struct.unpack(">I", data[at : at + 4])
        if at + 12 + size > len(data):
            raise Bad("truncated")
        body = data[at + 4 : at + 8 + size]
        if zlib.crc32(body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Bad("bad_checksum")
        yield body[:4], body[4:]
        if body[:4] == b"IEND":
            return
        at += 12 + size
    raise Bad("truncated")


def unfilter(raw: np.ndarray, kinds: np.ndarray, pixel: int, above: np.ndarray | None = None) -> np.ndarray:
    """raw: (pictures, rows, bytes) filtered lines, kinds: (pictures, rows) filters, pixel: bytes of a pixel, above: the
    (pictures, bytes) lines before the first, if any. Returns the lines.

    Pictures of one shape are done at once. Lines with the filters none, sub and up alone are whole-line
    operations. With average or Paeth lines they are swept by diagonals, on which no pixel depends on another.
    """
    pictures, rows, width = raw.shape
    if above is None:
        above = np.zeros((pictures, width), np.uint8)
    if not (kinds > 2).any():
        out = np.zeros(raw.shape, np.uint8)
        for y in range(rows):
            line, kind = raw[:, y], kinds[:, y, None]
            along = np.add.accumulate(line.reshape(pictures, -1, pixel), axis=1, dtype=np.uint8).reshape(pictures, width)
            out[:, y] = above = np.where(kind == 1, along, np.where(kind == 2, line + above, line))
        return out
    across = width // pixel
    f = raw.reshape(pictures, rows, across, pixel)
    r = np.zeros((pictures, rows + 1, across + 1, pixel), np.int16)
    r[:, 0, 1:] = above.reshape(pictures, across, pixel)
    for d in range(rows + across - 1):
        y = np.arange(max(0, d - across + 1), min(rows, d + 1))
        x = d - y
        a, b, c = r[:, y + 1, x], r[:, y, x + 1], r[:, y, x]
        p = a + b - c
        da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        paeth = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        kind = kinds[:, y, None]
        guess = np.where(kind == 4, paeth, np.where(kind == 3, (a + b) >> 1, np.where(kind == 2, b, np.where(kind == 1, a, 0))))
        r[:, y + 1, x + 1] = (f[:, y, x] + guess) & 255
    return r[:, 1:, 1:].astype(np.uint8).reshape(raw.shape)


def parse(data: bytes) -> tuple[tuple, np.ndarray | None, bytes]:
    """(header, palette, zlib stream); raises Bad."""
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise Bad("bad_header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise Bad("bad_header")
    width, height, depth, colour, compression, filtering, interlace = head
    depths = {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(colour, (8, 16))
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31 or colour not in CHANNELS or compression or filtering or interlace > 1 or depth not in depths:
        raise Bad("bad_header")
    return head, palette, b"".join(packed)


def passes(head: tuple) -> list[tuple[int, int, int, int, int, int]]:
    """(first column, first row, step across, step down, width, height) of the passes that have pixels."""
    size = ((x, y, dx, dy, -(-(head[0] - x) // dx), -(-(head[1] - y) // dy)) for x, y, dx, dy in (ADAM7 if head[6] else PLAIN))
    return [p for p in size if p[4] > 0 and p[5] > 0]


def line_bytes(head: tuple, width: int) -> int:
    return (width * CHANNELS[head[3]] * head[2] + 7) // 8


def size_of(head: tuple) -> int:
    """Bytes of a picture's lines with their filters."""
    return sum(h * (line_bytes(head, w) + 1) for *_, w, h in passes(head))


def bands(head: tuple, packed: bytes, most: int = BAND_BYTES) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """(pass, first row in the pass, lines with each line's filter in front), about most bytes at a time; raises Bad."""
    if size_of(head) > MOST_DEFLATED * len(packed):
        raise Bad("bad_stream")
    stream, rest = zlib.decompressobj(), packed
    try:
        for step in passes(head):
            line = line_bytes(head, step[4]) + 1
            rows = max(1, most // line)
            for row in range(0, step[5], rows):
                want = min(rows, step[5] - row) * line
                parts, have = [], 0
                while have < want:
                    part = stream.decompress(rest, want - have)
                    rest = stream.unconsumed_tail
                    if not part and (stream.eof or not rest):
                        raise Bad("bad_stream")
                    parts.append(part)
                    have += len(part)
                lines = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, line)
                if (lines[:, 0] > 4).any():
                    raise Bad("bad_filter")
                yield step, row, lines
        # the stream's own checksum stands behind the last line
        if not stream.eof and (stream.decompress(rest, 1) or not stream.eof):
            raise Bad("bad_stream")
    except zlib.error:
        raise Bad("bad_stream") from None


def unfiltered(head: tuple, packed: bytes, most: int = BAND_BYTES) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """bands, without filters: each band begins with the line that the one before it ended with."""
    above = None
    for step, row, lines in bands(head, packed, most):
        flat = unfilter(lines[None, :, 1:], lines[None, :, 0], pixel_bytes(head), above if row else None)
        above = flat[:, -1]
        yield step, row, flat[0]


def pixel_bytes(head: tuple) -> int:
    return max(1, CHANNELS[head[3]] * head[2] // 8)


def brightness(head: tuple, palette: np.ndarray | None, flat: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) brightness from 0 to 255 of unfiltered lines, transparency on black; raises Bad."""
    rows, (depth, colour) = len(flat), head[2:4]
    channels = CHANNELS[colour]
    if depth == 16:
        flat = flat[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(rows, -1, depth)
        flat = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :width].astype(np.float64)
        if colour == 0:
            flat = flat * (255 / ((1 << depth) - 1))
    x = flat[:, : width * channels].reshape(rows, width, channels).astype(np.float64)
    if colour == 3:
        if palette is None or x.max() >= len(palette):
            raise Bad("bad_palette")
        x = palette[x[:, :, 0].astype(np.int64)].astype(np.float64)
    elif colour in (4, 6):
        x = x[:, :, :-1] * (x[:, :, -1:] / 255)
    return x[:, :, 0] if x.shape[2] == 1 else x @ np.array([0.299, 0.587, 0.114])


def decode(data: bytes, most: int = BAND_BYTES) -> np.ndarray:
    """(height, width) brightness of one picture; raises Bad."""
    head, palette, packed = parse(data)
    out = np.zeros((head[1], head[0]))
    for (x, y, dx, dy, w, _), row, flat in unfiltered(head, packed, most):
        out[y + row * dy : y + (row + len(flat)) * dy : dy, x::dx] = brightness(head, palette, flat, w)
    return out


def _weights(cell: np.ndarray, n: int) -> np.ndarray:
    """(SIDE, cells) shares of some of n samples in the averages over SIDE equal stretches."""
    edge = np.arange(SIDE + 1) * n / SIDE
    overlap = np.minimum(edge[1:, None], cell[None] + 1) - np.maximum(edge[:-1, None], cell[None])
    return np.maximum(overlap, 0) * SIDE / n


@functools.lru_cache(maxsize=256)
def _areas(n: int) -> np.ndarray:
    return _weights(np.arange(n), n)


def shrink(data: bytes, most: int = BAND_BYTES) -> tuple[tuple[int, int], np.ndarray]:
    """((height, width), SIDE x SIDE brightness) of one picture, of which a band at a time is in memory; raises Bad."""
    head, palette, packed = parse(data)
    small, bits = np.zeros((SIDE, SIDE)), CHANNELS[head[3]] * head[2]
    for (x, y, dx, dy, w, _), row, flat in unfiltered(head, packed, most):
        down = _weights(y + dy * np.arange(row, row + len(flat)), head[1])
        for at in range(0, w, BAND_PIXELS):
            wide = min(BAND_PIXELS, w - at)
            part = brightness(head, palette, flat[:, at * bits // 8 : -(-(at + wide) * bits // 8)], wide)
            small += down @ part @ _weights(x + dx * np.arange(at, at + wide), head[0]).T
    return (head[1], head[0]), small


_K = np.arange(LOW)[:, None]
_DCT = np.cos(np.pi * _K * (2 * np.arange(SIDE)[None] + 1) / (2 * SIDE)) * np.where(_K == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def _signs(small: np.ndarray) -> bytes:
    low = (_DCT @ small @ _DCT.T).ravel()
    return np.packbits(low > np.median(low[1:]) + 1e-6).tobytes()


def perceptual(picture: np.ndarray) -> bytes:
    return _signs(_areas(picture.shape[0]) @ picture @ _areas(picture.shape[1]).T)


#: Bytes of inflated lines that are held and unfiltered at once.
HELD_BYTES = 1 << 23


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        status, size, hashes = ["ok"] * n, [(None, None)] * n, [None] * n
        held: dict[tuple, list] = {}
        weight = 0

        def flush() -> None:
            for (_, _, pixel), group in held.items():  # noqa: B023
                lines = np.stack([g[3] for g in group])
                for (i, head, palette, _), flat in zip(group, unfilter(lines[:, :, 1:], lines[:, :, 0], pixel)):
                    try:
                        picture = brightness(head, palette, flat, head[0])
                        size[i], hashes[i] = picture.shape, perceptual(picture)  # noqa: B023
                    except Bad as bad:
                        status[i] = str(bad)  # noqa: B023
            held.clear()  # noqa: B023

        for i in range(n):
            data = batch.column(1)[i].as_py()
            try:
                if data is None:
                    raise Bad("null")
                head, palette, packed = parse(bytes(data))
                if head[6] or size_of(head) > HELD_BYTES:
                    size[i], small = shrink(bytes(data))
                    hashes[i] = _signs(small)
                    continue
                ((_, _, lines),) = bands(head, packed, HELD_BYTES)
            except Bad as bad:
                status[i] = str(bad)
                continue
            held.setdefault((*lines.shape, pixel_bytes(head)), []).append((i, head, palette, lines))
            weight += lines.nbytes
            if weight >= HELD_BYTES:
                flush()
                weight = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(status, pa.string()), pa.array([s[1] for s in size], pa.int32()), pa.array([s[0] for s in size], pa.int32()), pa.array(hashes, pa.binary())],
            ["media_id", "status", "width", "height", "hash"],
        )


def hash_pictures(media: DataFrame) -> DataFrame:
    """(media_id, status, width, height, hash) for each row of media.

    media has media_id (bigint) and png (binary); other columns are ignored. status is "ok", or why there is no
    hash: "null", "no_png", "truncated", "bad_checksum" (a chunk's CRC), "bad_header", "bad_stream" (zlib, its
    Adler-32, or a wrong number of bytes), "bad_filter" or "bad_palette"; width, height and hash are then null.
    One bad picture never stops the others. Null ids and repeated rows get a row like any. Pictures are decoded
    whole, whatever their size, interlaced ones too: those of one shape share the unfiltering, HELD_BYTES at
    once, and larger ones are read in bands. Of 16-bit samples the high bytes count. An empty table gives no rows.
    """
    return media.select("media_id", "png").transform(in_arrow, _hash, "media_id long, status string, width int, height int, hash binary")


def encode(picture: np.ndarray, filters: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey PNG of (height, width) bytes with the given filter for each line."""
    height, width = picture.shape
    p = picture.astype(np.int16)
    a, b, c = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    a[:, 1:], b[1:], c[1:, 1:] = p[:, :-1], p[:-1], p[:-1, :-1]
    q = a + b - c
    da, db, dc = np.abs(q - a), np.abs(q - b), np.abs(q - c)
    guesses = [np.zeros_like(p), a, b, (a + b) >> 1, np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))]
    guess = np.stack(guesses)[filters, np.arange(height)]
    lines = np.concatenate([filters[:, None].astype(np.uint8), ((p - guess) & 255).astype(np.uint8)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def _painter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not value:
                out.append(None)
                continue
            x = np.nan_to_num(np.array(value, np.float64))
            side = int(np.ceil(np.sqrt(len(x))))
            x = np.pad(x, (0, side * side - len(x))).reshape(side, side)
            grey = np.rint(np.clip(x * 256 + 128, 0, 255)).astype(np.uint8)
            out.append(encode(grey, (np.arange(side) + (k or 0)) % 5))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["media_id", "png"])


def paint(vectors: DataFrame) -> DataFrame:
    """(media_id, png): each vector (vec_id, embedding) as a square grey picture, its lines using all five filters in turn."""
    return vectors.select("vec_id", "embedding").transform(in_arrow, _painter, "media_id long, png binary")
