"""Images and files against plain computations."""

import io
import struct
import zlib

import numpy as np
import pytest

from sievelight.functions import imaging
from sievelight.sources import files

r = np.random.default_rng(8)


def filtered_png(pixels, kinds, color):
    """A PNG whose lines use the given filters."""
    high, wide, ch = pixels.shape
    rows, above = [], np.zeros(wide * ch, int)
    for y in range(high):
        line, out = pixels[y].ravel().astype(int), []
        for x, v in enumerate(line):
            a, b, c = (line[x - ch] if x >= ch else 0), above[x], (above[x - ch] if x >= ch else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kinds[y % len(kinds)]]) % 256)
        rows.append(bytes([kinds[y % len(kinds)], *out]))
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return files.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("color, ch", [(0, 1), (4, 2), (2, 3), (6, 4)])
def test_png_filters(color, ch):
    pixels = r.integers(0, 256, (11, 7, ch))
    got = files.decode_png(filtered_png(pixels, [0, 1, 2, 3, 4], color))
    want = pixels[..., 0] if ch < 3 else (299 * pixels[..., 0] + 587 * pixels[..., 1] + 114 * pixels[..., 2] + 500) // 1000
    assert np.array_equal(got, want)


def test_broken_png_is_refused():
    good = files.encode_png(r.integers(0, 256, (5, 6)))
    assert files.decode_png(good).shape == (5, 6) and files.header(good) == ("png", 6, 5)
    for bad in (good[:20] + b"x" + good[21:], b"GIF", good[:9]):
        with pytest.raises(ValueError):
            files.decode_png(bad)


def test_headers():
    stream = io.BytesIO()
    np.save(stream, np.zeros((3, 4)))
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 8
    assert files.header(stream.getvalue()) == ("npy", 4, 3) and files.header(jpeg) == ("jpeg", 40, 30)
    assert files.header(b"") == ("unknown", None, None) and files.header(jpeg[:6])[0] == "jpeg"


def test_components_against_a_flood():
    for share in (0.3, 0.6, 0.9):
        mask = r.random((17, 23)) < share
        left, sizes = {tuple(p) for p in np.argwhere(mask)}, []
        while left:
            todo, n = [left.pop()], 0
            while todo:
                y, x = todo.pop()
                n += 1
                for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if near in left:
                        left.remove(near)
                        todo.append(near)
            sizes.append(n)
        assert imaging.components(mask) == (len(sizes), max(sizes) / mask.sum())
    assert imaging.components(np.zeros((3, 3), bool)) == (0, 0.0)


def test_box_mean_against_every_cell():
    g = r.integers(0, 256, (9, 12))
    for reach in range(5):
        got = imaging.box_mean(g, reach)
        for y in range(9):
            for x in range(12):
                part = g[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
                assert got[y, x] == (2 * part.sum() + part.size) // (2 * part.size)


def test_smoothed_pages_are_less_sharp_and_spots_are_glare():
    m = {k: dict(zip(imaging.METRICS, imaging.measures(imaging.specimen(k)), strict=True)) for k in (1, 3, 4, 5)}
    assert m[3]["sharpness"] < 0.05 * m[1]["sharpness"] and m[4]["glare"] > 0.05 > m[1]["glare"] and m[5]["mean"] < 90 < m[1]["mean"] and m[1]["lines"] == 7


def test_banks_and_arrays(spark):
    stream = io.BytesIO()
    np.savez(stream, features=np.arange(6.0).reshape(2, 3), labels=np.array(["a", "b"]))
    df = spark.createDataFrame([("x.npz", stream.getvalue())], "path string, content binary")
    assert [(x.row, x.label, x.vector) for x in files.bank(df).orderBy("row").collect()] == [(0, "a", [0.0, 1.0, 2.0]), (1, "b", [3.0, 4.0, 5.0])]
    broken = spark.createDataFrame([("y", b"no array")], "path string, content binary")
    assert files.arrays(broken).first().n_rows is None
