"""Bitmaps, perceptual hashes, crops and the table function of faces."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.plans import slots
from siftwright.sources import bitmaps


def bmp(pixels, bits=24, top_down=False):
    """A bitmap file of (row, column, red-green-blue) pixels."""
    rows, width, _ = pixels.shape
    body = b""
    for line in pixels if top_down else pixels[::-1]:
        one = b"".join(bytes((*p[::-1], *([255] if bits == 32 else []))) for p in line.tolist())
        body += one + b"\0" * (-len(one) % 4)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(body), 0, 54, 40, width, -rows if top_down else rows, 1, bits, 0, len(body), 0, 0, 0, 0) + body


def picture(rows, width, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (rows, width, 3)).astype(np.uint8)


def plain_hash(pixels):
    """The hash by loops over its definition."""
    grid = [[0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in line] for line in pixels.tolist()]

    def smooth(line):
        n, full = len(line), (len(line) + 127) // 128
        half = (full + 2) // 2
        return [sum(part) / len(part) for part in (line[max(0, i - full + half) : i + half] for i in range(n))]

    for _ in range(2):
        grid = [smooth(line) for line in grid]
        grid = [list(x) for x in zip(*(smooth(list(column)) for column in zip(*grid)))]
    small = [[grid[int((i + 0.5) * len(grid) / 64)][int((j + 0.5) * len(grid[0]) / 64)] for j in range(64)] for i in range(64)]
    d = [[math.sqrt(2 / 64) * math.cos(math.pi / 128 * k * (2 * j + 1)) for j in range(64)] for k in range(1, 17)]
    half_way = [[sum(d[k][i] * small[i][j] for i in range(64)) for j in range(64)] for k in range(16)]
    values = [sum(half_way[k][j] * d[m][j] for j in range(64)) for k in range(16) for m in range(16)]
    middle = sorted(values)[127]
    return f"{sum((v > middle) << i for i, v in enumerate(values)):064x}"


@pytest.mark.parametrize("rows, width", [(64, 64), (70, 200), (300, 17), (3, 5)])
def test_hash_as_by_loops(rows, width):
    pixels = picture(rows, width)
    assert bitmaps.hashes(bitmaps.reduced(pixels)[None]) == [plain_hash(pixels)]


def test_bitmaps_of_every_form_decode_alike():
    pixels = picture(5, 7)
    netpbm = b"P6\n# a remark\n7 5\n255\n" + pixels.tobytes()
    for data in (bmp(pixels), bmp(pixels, 32), bmp(pixels, top_down=True), netpbm):
        assert (bitmaps.decode(data) == pixels).all()
    grey = bitmaps.decode(b"P5 3 2 255\n" + bytes(range(6)))
    assert grey.shape == (2, 3, 3) and grey[1, 2].tolist() == [5, 5, 5]
    for broken in (None, b"", b"BM", bmp(pixels)[:-1], netpbm[:-1], b"\x89PNG" + b"x" * 100, b"P6 0 0 255\n", b"BM" + b"\xff" * 60):
        assert bitmaps.decode(broken) is None


def test_hashes_in_a_table(spark):
    near = picture(90, 120)
    moved = np.clip(near.astype(int) + 3, 0, 255).astype(np.uint8)
    rows = [("a", bmp(near)), ("b", bmp(moved)), ("c", b"no picture"), ("d", None), ("e", bmp(picture(90, 120, 9)))]
    got = dict(spark.createDataFrame(rows, "id string, content binary").repartition(2).select("id", bitmaps.perceptual_hash(F.col("content")).alias("h")).collect())
    assert got["a"] == plain_hash(near) and got["c"] == got["d"] == ""
    differ = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert differ(got["a"], got["b"]) < 20 < differ(got["a"], got["e"])


def test_bitmaps_made_in_the_jvm(spark):
    pixels = picture(9, 8)
    body = b"".join(bytes(x for p in line.tolist() for x in p[::-1]) for line in pixels[::-1])
    made = spark.createDataFrame([(body, 9)], "b binary, n int").select(bitmaps.bmp_of(F.col("b"), 8, F.col("n")).alias("x")).first().x
    assert (bitmaps.decode(bytes(made)) == pixels).all()


def test_crops_are_clipped_at_the_border(spark):
    pixels = picture(6, 10)
    boxes = [(0, 0, 10, 6), (2, 1, 3, 4), (-3, -2, 5, 5), (8, 4, 9, 9), (20, 20, 3, 3), (4, 4, 0, 2), (4, 4, -1, 2), (None, 0, 1, 1)]
    rows = spark.createDataFrame([(i, pixels.tobytes(), 10, 6, *b) for i, b in enumerate(boxes)], "i int, p binary, w int, h int, bx int, by int, bw int, bh int")
    box = [F.col(c) for c in ("bx", "by", "bw", "bh")]
    got = dict(rows.select("i", bitmaps.crop_digest(F.col("p"), F.col("w"), F.col("h"), box)).collect())
    for i, (x, y, w, h) in enumerate(boxes[:-1]):
        part = pixels[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] if w > 0 and h > 0 else pixels[:0]
        assert got[i] == hashlib.sha256(part.tobytes()).hexdigest()
    assert got[7] is None


CELL = "array<struct<cx double, cy double, w double, h double, score double>>"
FRAME = "struct<scale double, pad_w double, pad_h double, width int, height int>"


def images(spark):
    frame = (1.0, 0.0, 0.0, 100, 100)
    rows = [
        ("many", [(20.0, 20.0, 20.0, 20.0, 0.9), (21.0, 20.0, 20.0, 20.0, 0.8), (80.0, 80.0, 30.0, 20.0, 0.95), (50.0, 50.0, 10.0, 10.0, 0.7), None, (1.0, None, 1.0, 1.0, 0.9), (float("nan"), 1.0, 1.0, 1.0, 0.9)], frame),
        ("none", [(20.0, 20.0, 20.0, 20.0, 0.1)], frame),
        ("empty", [], frame),
        ("null", None, frame),
        ("unframed", [(20.0, 20.0, 20.0, 20.0, 0.9)], None),
    ]
    return spark.createDataFrame(rows, f"image string, cells {CELL}, frame {FRAME}")


def test_faces_of_images(spark):
    table = slots.face_table({"wide": ("boolean", lambda box, frame: box[2] - box[0] > 22), "size": ("int", lambda box, frame: box[2] - box[0])})
    got = [tuple(r) for r in slots.faces_of(images(spark), table, "size,wide").select("image", "face_idx", "box", "score", "size", "wide").orderBy("face_idx").collect()]
    assert got == [("many", 0, [67, 67, 92, 92], 0.95, 25, True), ("many", 1, [7, 7, 32, 32], 0.9, 25, True)]
    kept = slots.faces_of(images(spark), table, keep_empty=True)
    assert kept.columns[-3:] == ["face_idx", "box", "score"] and kept.count() == 6 and kept.where("face_idx IS NULL").count() == 4


def test_faces_are_checked_when_they_are_analysed(spark):
    table = slots.face_table()
    with pytest.raises(Exception, match="no model"):
        slots.faces_of(images(spark), table, "age").schema
    with pytest.raises(Exception, match="cells must be"):
        slots.faces_of(images(spark).withColumn("cells", F.lit("x")), table).schema
    with pytest.raises(Exception, match="frame must be"):
        slots.faces_of(images(spark).withColumn("frame", F.lit(1)), table).schema


def test_faces_are_not_joined_back_by_their_cells(spark):
    kept = slots.faces_of(images(spark), slots.face_table(), keep_empty=True)
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.image for r in kept.where("face_idx IS NULL AND box IS NULL AND score IS NULL").collect()) == ["empty", "none", "null", "unframed"]
