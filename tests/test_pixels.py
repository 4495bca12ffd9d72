"""Pixels against pictures that are made pixel by pixel, each rule on both sides of its bound."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from payscope.functions import pixels as px
from payscope.operators.logos import best_logo, normalised_logos
from payscope.plans import builds


def noise(height, width, seed=0, opaque=True):
    out = np.random.default_rng(seed).integers(0, 256, (height, width, 4), np.uint8)
    if opaque:
        out[:, :, 3] = 255
    return out


def png(width, height, depth, colour, rows, extra=b"", interlaced=0):
    """PNG data of rows that carry their filter bytes already."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = zlib.compress(rows)
    cut = len(body) // 2  # data in two chunks
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", body[:cut]) + chunk(b"IDAT", body[cut:]) + chunk(b"IEND", b"")


def filtered(picture, step, kinds):
    """Rows of bytes under PNG filters, by the definition of each."""
    rows, out, before = picture.reshape(len(picture), -1).astype(int), b"", None
    for kind, row in zip(kinds, rows, strict=True):
        line = []
        for i, x in enumerate(row):
            a = row[i - step] if i >= step else 0
            b = before[i] if before is not None else 0
            c = before[i - step] if before is not None and i >= step else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        out += bytes([kind, *line])
        before = row
    return out


def test_round_trip_and_filters():
    rng = random.Random(1)
    for step, colour in ((4, 6), (3, 2), (1, 0), (2, 4)):
        picture = np.random.default_rng(step).integers(0, 256, (11, 7, step), np.uint8)
        data = png(7, 11, 8, colour, filtered(picture, step, [rng.randrange(5) for _ in range(11)]))
        got = px.picture_of(data)
        colours = picture[:, :, :3] if step > 2 else np.repeat(picture[:, :, :1], 3, axis=2)
        opacity = picture[:, :, -1] if step in (2, 4) else np.full((11, 7), 255)
        assert (got[:, :, :3] == colours).all() and (got[:, :, 3] == opacity).all()
        assert (px.picture_of(px.png_bytes(got)) == got).all()


def test_palettes_and_depths():
    palette = struct.pack(">I4s", 9, b"PLTE") + bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]) + b"crc_"
    clear = struct.pack(">I4s", 2, b"tRNS") + bytes([0, 128]) + b"crc_"
    got = px.picture_of(png(5, 2, 2, 3, bytes([0, 0b00011000, 0b01000000]) + bytes([0, 0b10101010, 0b10000000]), palette + clear))
    assert got[0, 1].tolist() == [4, 5, 6, 128] and got[0, 0].tolist() == [1, 2, 3, 0] and got[0, 2].tolist() == [7, 8, 9, 255] and got[1, 4, 3] == 255
    grey = px.picture_of(png(8, 1, 1, 0, bytes([0, 0b10110000])))
    assert grey[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 0]
    deep = px.picture_of(png(1, 1, 16, 2, bytes([0, 10, 99, 20, 99, 30, 99])))
    assert deep[0, 0].tolist() == [10, 20, 30, 255]
    keyed = px.picture_of(png(2, 1, 8, 2, bytes([0, 1, 2, 3, 9, 9, 9]), struct.pack(">I4s6s", 6, b"tRNS", bytes([0, 1, 0, 2, 0, 3])) + b"crc_"))
    assert keyed[0, :, 3].tolist() == [0, 255]


def bitmap(picture, bits, opacity=None):
    height, width = picture.shape[:2]
    rows = b""
    for row in picture[::-1]:
        line = b"".join(bytes([b, g, r]) + (bytes([a if opacity is None else opacity]) if bits == 32 else b"") for r, g, b, a in row.tolist())
        rows += line + b"\0" * (-len(line) % 4)
    return struct.pack("<IiiHHIIiiII", 40, width, 2 * height, 1, bits, 0, 0, 0, 0, 0, 0) + rows + b"\0" * (height * (-(-width // 32) * 4))


def icon(*entries):
    out, at = struct.pack("<HHH", 0, 1, len(entries)), 6 + 16 * len(entries)
    for width, height, data in entries:
        out += struct.pack("<BBBBHHII", width % 256, height % 256, 0, 0, 1, 32, len(data), at)
        at += len(data)
    return out + b"".join(data for *_, data in entries)


def test_icons():
    small, large = noise(5, 3, 1, opaque=False), noise(6, 7, 2)
    assert (px.picture_of(icon((3, 5, bitmap(small, 32)))) == small).all()
    assert (px.picture_of(icon((3, 5, bitmap(small, 24))))[:, :, :3] == small[:, :, :3]).all()
    assert (px.picture_of(icon((3, 5, bitmap(small, 32, opacity=0))))[:, :, 3] == 255).all()  # no opacity at all means opaque
    assert (px.picture_of(icon((3, 5, bitmap(small, 32)), (7, 6, px.png_bytes(large)))) == large).all()
    broken = icon((3, 5, bitmap(small, 32)), (7, 6, px.png_bytes(large)))[:-5]
    assert (px.picture_of(broken) == small).all()  # the larger one isn't there as a whole
    assert px.picture_of(icon((3, 5, bitmap(small, 32)[:50]))) is None and px.picture_of(icon()) is None


@pytest.mark.parametrize("data", [None, b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", png(2, 2, 8, 6, b"\0" * 5), png(2, 2, 8, 6, b"\0" * 18, interlaced=1), png(9999, 9999, 8, 6, b""), png(2, 1, 8, 6, b"\x09" + b"\0" * 8), png(1, 1, 8, 3, b"\0\0")])
def test_what_is_no_picture(data):
    assert px.picture_of(data) is None and px.rejection(px.picture_of(data)) == "notImage"


def test_means_of_areas():
    picture = noise(12, 20, 3)
    assert (px.resized(picture, 12, 20) == picture).all()
    half = px.resized(picture, 6, 10).astype(float)
    want = picture.reshape(6, 2, 10, 2, 4).mean(axis=(1, 3))
    assert np.abs(half - want).max() <= 0.51
    thin = px.resized(picture, 5, 7)
    assert thin.shape == (5, 7, 4) and abs(thin[:, :, 0].mean() - picture[:, :, 0].mean()) < 1
    faint = np.zeros((2, 2, 4), np.uint8)
    faint[0, 0] = [200, 100, 50, 255]  # what is transparent has no colour to add
    assert px.resized(faint, 1, 1)[0, 0].tolist() == [200, 100, 50, 64]


def test_rules_on_both_sides():
    assert px.rejection(noise(1, 9)) == "tooTiny" and px.rejection(noise(2, 9)) is None
    assert px.rejection(noise(2, 41)) == "extremeRatio" and px.rejection(noise(2, 40)) is None and px.rejection(noise(41, 2)) == "extremeRatio"
    plain = np.full((24, 24, 4), 255, np.uint8)
    assert px.rejection(plain) == "solidColor"
    for step, reason in ((12, "solidColor"), (13, None)):
        other = plain.copy()
        other[5, 5, 1] -= step
        assert px.rejection(other) == reason
    for holes, reason in ((2, "solidColor"), (3, None)):  # of 576 pixels; one colour with a shape is kept
        shape = plain.copy()
        shape.reshape(-1, 4)[:holes, 3] = 0
        assert px.rejection(shape) == reason
    for marks, reason in ((2, "almostTransparent"), (3, None)):
        clear = np.zeros((24, 24, 4), np.uint8)
        clear.reshape(-1, 4)[:marks] = 255
        assert px.rejection(clear) == reason
    faint = np.full((24, 24, 4), 15, np.uint8)
    assert px.rejection(faint) == "almostTransparent"


def test_one_size():
    picture = np.full((300, 500, 4), 250, np.uint8)
    picture[50:242, 100:292] = noise(192, 192, 4)
    got = px.normalised(picture)
    assert got.shape == (96, 96, 4) and np.abs(got.astype(int) - px.resized(picture[50:242, 100:292], 96, 96)).max() == 0
    wide = noise(100, 1000, 5)
    assert px.normalised(wide).shape == (38, 384, 4)
    small = noise(9, 9, 6)
    assert (px.normalised(small) == small).all()  # never enlarged
    near = np.full((30, 30, 4), 100, np.uint8)
    near[10:20, 10:20] = 108  # within the threshold
    assert px.normalised(near).shape == (30, 30, 4)
    near[10:20, 10:20] = 109
    assert px.normalised(near).shape == (10, 10, 4)


def test_logos_of_companies(spark):
    fine = px.png_bytes(noise(200, 100, 7))
    rows = [(1, "a", 0, b"no image"), (2, "a", 2, fine), (3, "a", 1, icon((3, 5, bitmap(noise(5, 3, 8), 32)))), (4, "b", 0, None), (5, "c", 1, fine), (6, "c", 0, px.png_bytes(np.full((9, 9, 4), 255, np.uint8)))]
    candidates = spark.createDataFrame(rows, "id int, company string, place int, image binary").repartition(3)
    normal = normalised_logos(candidates)
    got = {r.id: (r.reason, r.width, r.height) for r in normal.collect()}
    assert got == {1: ("notImage", None, None), 2: (None, 48, 96), 3: (None, 3, 5), 4: ("notImage", None, None), 5: (None, 48, 96), 6: ("solidColor", None, None)}
    assert all(px.picture_of(bytes(r.png)).shape == (r.height, r.width, 4) for r in normal.where("reason IS NULL").collect())
    assert {r.company: r.id for r in best_logo(candidates.select("id", "company", "place"), normal).collect()} == {"a": 3, "c": 5}


def test_equal_results_by_edges_and_for_one_colour():
    rng = np.random.default_rng(7)
    for height, width, new in ((200, 61, (24, 7)), (96, 30, (96, 15)), (5, 9, (8, 20)), (1, 40, (1, 24))):
        picture = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
        planes = np.concatenate([picture[:, :, :3] * picture[:, :, 3:].astype(float), picture[:, :, 3:]], axis=2)
        for axis, size in enumerate(new):
            sums = np.concatenate([np.zeros_like(planes.take([0], axis)), planes.cumsum(axis)], axis)
            edges = np.linspace(0, planes.shape[axis], size + 1)
            low = np.minimum(edges.astype(int), planes.shape[axis] - 1)
            part = (edges - low).reshape([-1 if k == axis else 1 for k in range(3)])
            planes = np.diff(sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part, axis=axis) * size / planes.shape[axis]
        mean = np.concatenate([planes[:, :, :3] / np.maximum(planes[:, :, 3:], 1e-9), planes[:, :, 3:]], axis=2)
        assert (px.resized(picture, *new) == np.floor(np.clip(mean, 0, 255) + 0.5)).all()
    for opacity, reason in ((0, "almostTransparent"), (15, "almostTransparent"), (16, "solidColor"), (255, "solidColor")):
        assert px.rejection(np.full((30, 20, 4), opacity, np.uint8)) == reason


def test_pictures_of_a_small_file_are_dealt_over_tasks_and_handed_over_together(spark):
    assert builds.logo_rules(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
    picture = px.png_bytes(np.full((4, 4, 4), 255, np.uint8))
    table = spark.range(300, numPartitions=1).select("id", F.lit(picture).alias("image"))
    assert [tuple(r)[:2] for r in normalised_logos(table).orderBy("id").collect()] == [(k, "solidColor") for k in range(300)]
