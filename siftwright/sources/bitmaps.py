"""Raw bitmaps: made from pixels, decoded, hashed perceptually, and cropped.

Formats are uncompressed BMP (8-bit grey, 24 and 32 bits) and binary PGM / PPM; anything else is not decoded and has the hash
"" of a broken file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: side of the reduced picture, side of its transform, and the weights of red, green and blue.
REDUCED = 64
TRANSFORMED = 16
LUMA = (0.299, 0.587, 0.114)
#: Pictures with more pixels than this are not decoded.
MOST_PIXELS = 200_000_000


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels (row, column, red-green-blue) of a bitmap, or None where the bytes are none."""
    try:
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
    except (struct.error, ValueError, IndexError, TypeError):
        pass
    return None


def _bmp(data: bytes) -> np.ndarray | None:
    at, header, width, height, planes, bits, packing = struct.unpack("<I I i i H H I", data[10:34])
    rows = abs(height)
    if planes != 1 or bits not in (8, 24, 32) or packing not in (0, 3) or width <= 0 or not rows or width * rows > MOST_PIXELS:
        return None
    stride = (width * bits + 31) // 32 * 4
    flat = np.frombuffer(data, np.uint8, stride * rows, at).reshape(rows, stride)[:, : width * bits // 8]
    if height > 0:
        flat = flat[::-1]
    if bits > 8:
        return flat.reshape(rows, width, bits // 8)[:, :, 2::-1]
    used = struct.unpack("<I", data[46:50])[0] or 256
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
    return palette[flat]


def _netpbm(data: bytes) -> np.ndarray | None:
    head = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d{1,9})(?:\s+#[^\n]*)*\s+(\d{1,9})(?:\s+#[^\n]*)*\s+(\d{1,5})\s", data)
    if head is None or int(head[4]) != 255:
        return None
    width, rows, colours = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    if not 0 < width * rows <= MOST_PIXELS:
        return None
    flat = np.frombuffer(data, np.uint8, width * rows * colours, head.end()).reshape(rows, width, colours)
    return np.broadcast_to(flat, (rows, width, 3))


@lru_cache(1024)
def _box(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of the mean around each of n places; the window shrinks at the ends."""
    window = (n + 2 * REDUCED - 1) // (2 * REDUCED)
    ahead = (window + 2) // 2
    at = np.arange(n)
    return np.maximum(at - (window - ahead), 0), np.minimum(at + ahead, n)


def _smoothed(picture: np.ndarray, passes: int = 2) -> np.ndarray:
    """Box means along rows and columns, twice, by differences of running sums."""
    for _ in range(passes):
        for axis in (1, 0):
            lo, hi = _box(picture.shape[axis])
            sums = np.concatenate([np.zeros_like(picture.take([0], axis)), np.cumsum(picture, axis=axis)], axis=axis)
            counts = (hi - lo).reshape((1, -1) if axis else (-1, 1))
            picture = (sums.take(hi, axis) - sums.take(lo, axis)) / counts
    return picture


def reduced(pixels: np.ndarray) -> np.ndarray:
    """The smoothed luminance at 64 by 64 evenly spread places."""
    smooth = _smoothed(pixels.astype(float) @ np.array(LUMA))
    place = lambda n: ((np.arange(REDUCED) + 0.5) * n / REDUCED).astype(int)
    return smooth[np.ix_(place(pixels.shape[0]), place(pixels.shape[1]))]


def _cosines() -> np.ndarray:
    """Rows 1 to 16 of the cosine transform of 64 values."""
    k, j = np.arange(1, TRANSFORMED + 1)[:, None], np.arange(REDUCED)[None, :]
    return np.sqrt(2 / REDUCED) * np.cos(np.pi / (2 * REDUCED) * k * (2 * j + 1))


def hashes(pictures: np.ndarray) -> list[str]:
    """64 hex digits of each reduced picture: bits of the transform above its median, the last first."""
    if not len(pictures):
        return []
    d = _cosines()
    values = (d @ pictures @ d.T).reshape(len(pictures), -1)
    lower_median = np.sort(values, axis=1)[:, (values.shape[1] - 1) // 2][:, None]
    return [bits.tobytes().hex() for bits in np.packbits((values > lower_median)[:, ::-1], axis=1)]


def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        found = [decode(x) for x in batch]
        whole = [i for i, x in enumerate(found) if x is not None]
        out = np.full(len(batch), "", object)
        out[whole] = hashes(np.array([reduced(found[i]) for i in whole]).reshape(-1, REDUCED, REDUCED))
        yield pd.Series(out)


def perceptual_hash(content: Column) -> Column:
    """The perceptual hash of a bitmap's bytes as 64 hex digits; "" for bytes that are no bitmap, and for null."""
    from collections.abc import Iterator as It

    def run(batches: It[pd.Series]) -> It[pd.Series]:
        yield from _hashed(batches)

    run.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return F.pandas_udf(run, "string")(content)


# Means of the colours (red, green, blue) of two training sets.
CHANNEL_MEANS = {"VGGFace": (93.5940, 104.7624, 129.1863), "VGGFace2": (91.4953, 103.8827, 131.0912)}
NORMALISATIONS = ("base", "raw", "Facenet", "Facenet2018", "ArcFace", *CHANNEL_MEANS)


def normalised(pixels: Column, kind: str = "base") -> Column:
    """Pixels between 0 and 1 (three colours after one another, as doubles) as a model wants them; ``base`` leaves them as
    they are, the others begin with values up to 255. Pixels that are all alike have no deviation and give nulls in
    ``Facenet``, as does an empty picture."""
    if kind not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {kind!r}")
    if kind == "base":
        return pixels
    if kind == "Facenet":  # the factor cancels out
        n = F.size(pixels)
        mean = F.try_divide(F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x), n)
        spread = lambda m: F.sqrt(F.try_divide(F.aggregate(pixels, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), n))
        bound = F.transform(F.array(mean), lambda m: F.struct(m.alias("m"), spread(m).alias("s")))
        return F.flatten(F.transform(bound, lambda b: F.transform(pixels, lambda x: F.try_divide(x - b["m"], b["s"]))))
    scaled = lambda x: x * 255.0
    if kind in CHANNEL_MEANS:
        means = F.array(*map(F.lit, CHANNEL_MEANS[kind]))
        return F.transform(pixels, lambda x, i: scaled(x) - means[i % 3])
    each = {"raw": scaled, "Facenet2018": lambda x: scaled(x) / 127.5 - 1.0, "ArcFace": lambda x: (scaled(x) - 127.5) / 128.0}
    return F.transform(pixels, each[kind])


def little_endian(value: Column, size: int) -> Column:
    """A whole number as so many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))))


def bmp_of(pixels: Column, width: int, rows: Column) -> Column:
    """A 24-bit bitmap around pixels as the format stores them: blue-green-red, the bottom row first, rows of a multiple of
    four bytes."""
    number = lambda x, size: little_endian(x if isinstance(x, Column) else F.lit(x), size)
    size = rows * (width * 3)
    head = [F.lit(b"BM"), number(size + 54, 4), number(0, 4), number(54, 4), number(40, 4), number(width, 4), number(rows, 4), number(1, 2), number(24, 2), number(0, 4), number(size, 4), number(2835, 4), number(2835, 4), number(0, 8)]
    return F.concat(*head, pixels)


def cropped(pixels: Column, width: Column, rows: Column, box: list[Column], colours: int = 3) -> Column:
    """The pixels (top row first, ``colours`` bytes each) of a box (x, y, width, height), clipped at the picture's borders.

    One slice a row of the box, joined as text, so that work grows with the box alone.
    """
    x, y, w, h = box
    left, top = F.greatest(F.lit(0), F.least(x, width)), F.greatest(F.lit(0), F.least(y, rows))
    right, bottom = F.least(width, F.greatest(left, x + w)), F.least(rows, F.greatest(top, y + h))
    line = lambda r: F.hex(F.substr(pixels, ((r * width + left) * colours + 1).cast("int"), ((right - left) * colours).cast("int")))
    lines = F.when(bottom > top, F.transform(F.sequence(top, bottom - 1), line)).otherwise(F.array().cast("array<string>"))
    return F.unhex(F.array_join(lines, ""))


def crop_digest(pixels: Column, width: Column, rows: Column, box: list[Column], colours: int = 3) -> Column:
    """SHA-256 of a crop's pixels, by which a face is known; null where pixels or box are null."""
    known = pixels.isNotNull() & width.isNotNull() & rows.isNotNull()
    for side in box:
        known = known & side.isNotNull()
    return F.when(known, F.sha2(cropped(pixels, width, rows, box, colours), 256))
