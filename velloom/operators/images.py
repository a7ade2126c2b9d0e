"""Page images as arrays: line segmentation, crops, and PNG files without an imaging library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .series import peaks, smooth, total, word_ranges

#: Fixed values of line segmentation: rows of smoothing, distance and prominence of peaks, of the second look, least height and ink.
ROWS, DISTANCE, PROMINENCE = 15, 38, 0.06
TALL, INNER_DISTANCE, INNER_PROMINENCE = 1.5, 30, 0.03
LEAST_HEIGHT, LEAST_INK = 20, 0.15
#: Fixed value: pixels around a crop.
MARGIN = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The eight pixels of a byte of a black and white image.
_EIGHT = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * np.uint8(255)).view(np.uint64)[:, 0]


def _between(profile: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Ranges around the places ``at``, cut at the lowest row between two of them; low ranges are left out."""
    cuts = [0, *(int(a + profile[a:b].argmin()) for a, b in zip(at, at[1:])), len(profile)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a >= LEAST_HEIGHT]


def line_bands(ink: np.ndarray) -> list[tuple[int, int]]:
    """IMG3, FLT9: the rows of each line of writing in a page of ink (255); the whole page where nothing tells lines apart.

    Lines are peaks of the smoothed rows, parted at the lowest row between them; a band far above the (upper) median height is looked at
    once more with a finer measure; bands with little ink go.
    """
    whole = [(0, ink.shape[0])]
    rows = smooth(total(ink, 1) / 255, ROWS)
    top = rows.max(initial=0)
    at = peaks(rows, DISTANCE, PROMINENCE * top) if top > 0 else np.array([], int)
    bands = _between(rows, at) if len(at) else []
    if not bands:
        return whole
    usual = sorted(b - a for a, b in bands)[len(bands) // 2]
    found = []
    for a, b in bands:
        inner = rows[a:b]
        at = peaks(inner, INNER_DISTANCE, max(INNER_PROMINENCE * inner.max(), 1.0)) if b - a > TALL * usual else []
        found += [(a + x, a + y) for x, y in _between(inner, at)] if len(at) > 1 else [(a, b)]
    return [(a, b) for a, b in found if rows[a:b].max() > LEAST_INK * top] or whole


def crop(image: np.ndarray, rows: tuple[int, int], columns: tuple[int, int], margin: int = MARGIN) -> np.ndarray:
    """IMG11: a part of an image with a margin, as far as the image goes."""
    (y0, y1), (x0, x1) = rows, columns
    return image[max(0, y0 - margin) : y1 + margin, max(0, x0 - margin) : x1 + margin]


def word_crops(image: np.ndarray, ink: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """IMG3, IMG4, IMG11: (line, crop) of each word of a page, in reading order."""
    return [(i, crop(image, band, word)) for i, band in enumerate(line_bands(ink)) for word in word_ranges(ink[band[0] : band[1]])]


def decode_png(data: bytes) -> np.ndarray:
    """SRC1 for PNG: an 8-bit image, or a black and white one of a bit, that isn't interlaced, as (height, width, channels) bytes;
    palettes become RGB."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if not head or head[2:4] != (1, 0) and head[2] != 8 or head[6]:
        raise ValueError("not an 8-bit PNG without interlacing")
    width, height = head[:2]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    if head[2] == 1:
        packed = _unfiltered(body, height, -(-width // 8), 1)
        return _EIGHT[packed].view(np.uint8)[:, :width].reshape(height, width, 1)
    image = _unfiltered(body, height, width, channels).reshape(height, width, channels)
    return palette[image[:, :, 0]] if head[3] == 3 else image


def _unfiltered(body: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The rows of a PNG's packed ``body``, of ``width`` pixels of ``channels`` bytes."""
    raw = np.frombuffer(zlib.decompress(body, bufsize=height * (1 + width * channels) or 1), np.uint8).reshape(height, 1 + width * channels)
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((height + 1, (width + 1) * channels), np.uint8)  # a row above and a pixel to the left, all 0
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:], out[y]
        now = out[y + 1]
        if kind == 0:
            now[channels:] = line
        elif kind == 2:
            now[channels:] = line + up[channels:]
        elif kind == 1:
            now[channels:] = line.reshape(width, channels).cumsum(axis=0, dtype=np.uint8).reshape(-1)
        else:
            row, above = [0] * channels + line.tolist(), up.tolist()
            for i in range(channels, len(row)):
                a, b, c = row[i - channels], above[i], above[i - channels]
                if kind == 3:
                    p = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                row[i] = (row[i] + p) & 255
            now[:] = row
    return out[1:, channels:]


def encode_png(image: np.ndarray) -> bytes:
    """An image of (height, width) or (height, width, 1, 3 or 4) bytes as a PNG file; of a bit a pixel where all are black or white."""
    image = image.reshape(*image.shape[:2], -1)
    height, width, channels = image.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = image.reshape(height, width * channels)
    signed = rows.view(np.int8)
    bits = channels == 1 and rows.size > 0 and signed.min() >= -1 and signed.max() <= 0  # 0 and 255 alone
    rows = np.pad(np.packbits(rows, axis=1) if bits else rows, ((0, 0), (1, 0)))
    head = struct.pack(">IIBBBBB", width, height, 1 if bits else 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return _SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 1 if bits else -1)) + part(b"IEND", b"")


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness of each pixel."""
    return image[:, :, 0] if image.shape[2] < 3 else (image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def row_ink(page: np.ndarray) -> np.ndarray:
    """IMG10, AGG8, WIN4: how much darker than paper each row of a gray page is, smoothed; paper is the 90th percentile."""
    size = max(5, page.shape[0] // 220) | 1
    return smooth(np.clip(np.percentile(page, 90) - page.astype(np.float64), 0, None).mean(axis=1), size)


def valleys(profile: np.ndarray, share: float = 0.32, gap: int = 12) -> list[int]:
    """WIN5, WIN6: low local minima; those no further apart than ``gap`` are one, at the lowest of them."""
    inner = profile[1:-1]
    low = np.flatnonzero((inner <= profile[:-2]) & (inner <= profile[2:]) & (inner <= share * (profile.max(initial=0) or 1.0))) + 1
    groups = np.split(low, np.flatnonzero(np.diff(low) > gap) + 1)
    return [int(g[profile[g].argmin()]) for g in groups if len(g)]
