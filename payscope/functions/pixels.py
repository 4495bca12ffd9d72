"""Pixels of small images: reading PNG and ICO data, what makes a picture useless, and one size for all.

Pictures are arrays of height x width x 4 bytes (red, green, blue, opacity).  Data that can't be read, or that says it has more than ``MOST_PIXELS``, is no picture.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from payscope.functions.images import header_of

# --- fixed values: sizes and bounds of a logo ------------------------------------------------------
TARGET_HEIGHT, MOST_WIDTH, MOST_RATIO = 96, 384, 20
SAMPLE, FAINT, SAME_COLOUR, LEAST_OPAQUE, ALL_OPAQUE, TRIM = 24, 16, 12, 0.005, 0.995, 8
# -------------------------------------------------------------------------------------------------
MOST_PIXELS = 1 << 24
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_bytes(picture: np.ndarray) -> bytes:
    """PNG data of a picture: one unfiltered stream of 8-bit pixels."""
    height, width = picture.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), picture.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The bodies of the chunks by their kind, those of one kind joined."""
    out: dict[bytes, bytes] = {}
    at = len(_PNG)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        out[kind] = out.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    return out


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; ``step``: bytes from one pixel to the next."""
    if not raw[:, 0].any():
        return np.ascontiguousarray(raw[:, 1:])
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.int32)
    before = np.zeros(rows.shape[1], np.int32)
    for kind, row in zip(kinds.tolist(), rows, strict=True):
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0).ravel() & 255
        elif kind == 2:
            row[:] = (row + before) & 255
        elif kind in (3, 4):
            left = [0] * step
            corner = [0] * step
            for at in range(0, len(row), step):
                for k in range(step):
                    a, b, c = left[k], int(before[at + k]), corner[k]
                    guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda x, p=a + b - c: abs(p - x))
                    left[k] = row[at + k] = (int(row[at + k]) + guess) & 255
                    corner[k] = b
        elif kind:
            raise ValueError("unknown filter")
        before = row
    return rows.astype(np.uint8)


def _png_picture(data: bytes) -> np.ndarray:
    parts = _chunks(data)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][:13])
    if interlaced or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("not read")
    bits = _CHANNELS[colour] * depth
    line = -(-width * bits // 8)
    wanted = height * (line + 1)
    raw = np.frombuffer(zlib.decompressobj().decompress(parts[b"IDAT"], wanted), np.uint8)
    rows = _unfiltered(raw[:wanted].reshape(height, line + 1), max(1, bits // 8))
    if depth < 8:
        values = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width] @ (1 << np.arange(depth)[::-1])
        values = (values if colour == 3 else values * 255 // ((1 << depth) - 1)).astype(np.uint8)[:, :, None]
    else:
        values = rows.reshape(height, width, -1)[:, :, :: depth // 8]  # of 16 bits the upper 8
    full = lambda x: np.full((height, width, 1), x, np.uint8)
    if colour == 3:
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        opacity = np.full(len(palette), 255, np.uint8)
        opacity[: len(parts.get(b"tRNS", b""))] = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)[: len(palette)]
        return np.concatenate([palette[values[:, :, 0]], opacity[values]], axis=2)
    colours = values[:, :, :3] if colour in (2, 6) else np.repeat(values[:, :, :1], 3, axis=2)
    clear = parts.get(b"tRNS")
    if clear and colour in (0, 2):  # one colour that is transparent
        key = np.frombuffer(clear, ">u2") * (255 // ((1 << depth) - 1)) if depth < 8 else np.frombuffer(clear, ">u2") >> (depth - 8)
        opacity = np.where((values[:, :, : len(key)] == key.astype(np.uint8)).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)
    else:
        opacity = values[:, :, -1:] if colour in (4, 6) else full(255)
    return np.concatenate([colours, opacity], axis=2)


def _bitmap_picture(data: bytes) -> np.ndarray:
    """A bitmap of an icon: 24 or 32 bits, from the lowest row up, its stated height twice that of the picture.

    Where no pixel has any opacity, all are opaque.
    """
    header, width, height, _, bits = struct.unpack("<IiiHH", data[:16])
    height //= 2
    if bits not in (24, 32) or width <= 0 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("not read")
    line = -(-width * bits // 32) * 4
    rows = np.frombuffer(data[header : header + line * height], np.uint8).reshape(height, line)[::-1, : width * bits // 8].reshape(height, width, -1)
    opacity = rows[:, :, 3:] if bits == 32 and rows[:, :, 3].any() else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([rows[:, :, 2::-1], opacity], axis=2)


def _icon_entry(data: bytes) -> bytes:
    """The largest picture of an icon whose data is there; of equal ones the first."""
    best, found = -1, b""
    for k in range(int.from_bytes(data[4:6], "little")):
        entry = data[6 + 16 * k : 22 + 16 * k]
        if len(entry) < 16:
            break
        size, at = struct.unpack("<II", entry[8:])
        area = (entry[0] or 256) * (entry[1] or 256)
        if at + size <= len(data) and area > best:
            best, found = area, data[at : at + size]
    return found


def picture_of(data: bytes | None) -> np.ndarray | None:
    """The picture of PNG or ICO data; None if it isn't one that can be read."""
    data = data or b""
    try:
        if header_of(data)[0] == "ico":
            data = _icon_entry(data)
            return _png_picture(data) if data.startswith(_PNG) else _bitmap_picture(data)
        return _png_picture(data) if data.startswith(_PNG) else None
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture in another size: each new pixel is the mean over its area, colours weighing by their opacity.

    Means come from sums over the areas up to each edge, so parts of pixels count as parts.
    """
    planes = picture.astype(np.float64)
    planes[:, :, :3] *= planes[:, :, 3:]
    for axis, size in ((0, height), (1, width)):
        n = planes.shape[axis]
        edges = np.arange(size + 1) * (n / size)
        edges[-1] = n
        low = np.minimum(edges.astype(int), n - 1)
        if axis == 0 and size <= n:  # whole numbers: summing from edge to edge gives the same
            below = np.zeros((size + 1, *planes.shape[1:]))
            np.add.reduceat(planes, low[:-1]).cumsum(0, out=below[1:])
            below[-1] -= planes[-1]
            above = below + planes[low]
        else:
            sums = np.zeros([m + (k == axis) for k, m in enumerate(planes.shape)])
            planes.cumsum(axis, out=sums[1:] if axis == 0 else sums[:, 1:])
            below, above = sums.take(low, axis), sums.take(low + 1, axis)
        part = (edges - low).reshape([-1 if k == axis else 1 for k in range(3)])
        at = below * (1 - part) + above * part
        planes = (at[1:] - at[:-1] if axis == 0 else at[:, 1:] - at[:, :-1]) * size / n
    opacity = planes[:, :, 3:]
    colours = planes[:, :, :3] / np.maximum(opacity, 1e-9)
    return np.floor(np.clip(np.concatenate([colours, opacity], axis=2), 0, 255) + 0.5).astype(np.uint8)


def rejection(picture: np.ndarray | None) -> str | None:
    """Why a picture is of no use, or None: no image, too tiny, an extreme ratio, almost transparent, or one colour all over.

    One colour beside transparent parts is a shape and is kept.
    """
    if picture is None:
        return "notImage"
    height, width = picture.shape[:2]
    if min(height, width) < 2:
        return "tooTiny"
    if max(height, width) > MOST_RATIO * min(height, width):
        return "extremeRatio"
    if (picture == picture[0, 0]).all():  # so is every mean
        return "almostTransparent" if picture[0, 0, 3] < FAINT else "solidColor"
    scale = SAMPLE / max(height, width)
    small = resized(picture, max(1, round(height * scale)), max(1, round(width * scale)))
    seen = small[small[:, :, 3] >= FAINT].astype(int)
    share = len(seen) / (small.shape[0] * small.shape[1])
    if share < LEAST_OPAQUE:
        return "almostTransparent"
    varied = (np.abs(seen[:, :3] - seen[0, :3]) > SAME_COLOUR).any()
    return "solidColor" if share > ALL_OPAQUE and not varied else None


def normalised(picture: np.ndarray) -> np.ndarray:
    """The picture without its margin, within TARGET_HEIGHT and MOST_WIDTH, never enlarged.

    The margin is what looks like the first pixel up to the rows and columns with anything else; a picture of nothing else keeps it.
    """
    other = (np.abs(picture.astype(int) - picture[0, 0].astype(int)) > TRIM).any(axis=2)
    rows, columns = np.flatnonzero(other.any(axis=1)), np.flatnonzero(other.any(axis=0))
    if len(rows):
        picture = picture[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    height, width = picture.shape[:2]
    scale = min(TARGET_HEIGHT / height, MOST_WIDTH / width, 1)
    size = [max(1, int(side * scale + 0.5)) for side in (height, width)]
    return picture if size == [height, width] else resized(picture, *size)
