"""Scaling by area, frames and turns of pixel rows, against loops over exact fractions."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import resample


def by_area(px, w, h):
    """The mean over each target's area of the unit square, in fractions; alpha weighs colours."""
    height, width = len(px), len(px[0])
    out = []
    for ty in range(h):
        row = []
        for tx in range(w):
            alpha, colour = Fraction(0), [Fraction(0)] * 3
            for y in range(height):
                dy = min(Fraction(y + 1, height), Fraction(ty + 1, h)) - max(Fraction(y, height), Fraction(ty, h))
                for x in range(width):
                    dx = min(Fraction(x + 1, width), Fraction(tx + 1, w)) - max(Fraction(x, width), Fraction(tx, w))
                    if dx > 0 and dy > 0:
                        alpha += dx * dy * px[y][x][3]
                        colour = [c + dx * dy * px[y][x][3] * k for c, k in zip(colour, px[y][x])]
            row.append((*((int(c / alpha + Fraction(1, 2)) if alpha else 0) for c in colour), int(alpha * w * h + Fraction(1, 2))))
        out.append(row)
    return out


def images(spark, many):
    rows = [(i, len(px[0]), len(px), bytes(v for row in px for p in row for v in p)) for i, px in many.items()]
    return resample.pixel_rows(spark.createDataFrame(rows, "id long, width int, height int, rgba binary"), "id")


def grids(pixels):
    out = {}
    for r in pixels.collect():
        px = out.setdefault(r["image_id"], [[None] * r["width"] for _ in range(r["height"])])
        assert px[r["y"]][r["x"]] is None
        px[r["y"]][r["x"]] = (r["r"], r["g"], r["b"], r["a"])
    return out


@pytest.fixture(scope="module")
def many():
    dice = random.Random(5)
    pixel = lambda: (*(dice.randrange(256) for _ in range(3)), dice.choice((0, 255, dice.randrange(256))))
    sizes = [(1, 1), (7, 5), (5, 7), (12, 3), (3, 12), (8, 8)]
    return {i: [[pixel() for _ in range(w)] for _ in range(h)] for i, (w, h) in enumerate(sizes)}


@pytest.mark.parametrize("w, h", [(1, 1), (3, 4), (5, 5), (7, 5), (13, 2)])
def test_scaling_is_the_mean_by_area(spark, many, w, h):
    got = grids(resample.scaled(images(spark, many), F.lit(w), F.lit(h)))
    assert got == {i: by_area(px, w, h) for i, px in many.items()}


def test_turns_and_flips(spark, many):
    for quarters in range(-1, 4):
        for flip_h, flip_v in ((False, False), (True, False), (True, True)):
            got = grids(resample.turned(images(spark, many), quarters, flip_h, flip_v))
            for i, px in many.items():
                a = np.array(px)
                a = a[:, ::-1] if flip_h else a
                a = a[::-1] if flip_v else a
                assert np.array_equal(np.array(got[i]), np.rot90(a, -quarters))


@pytest.mark.parametrize("mode", ["contain", "cover"])
@pytest.mark.parametrize("ground", [(0, 0, 0, 0), (10, 200, 30, 255)])
def test_frames(spark, many, mode, ground):
    got = grids(resample.fitted(images(spark, many), 6, 4, mode, ground))
    for i, px in many.items():
        k = (max if mode == "cover" else min)(Fraction(6, len(px[0])), Fraction(4, len(px)))
        w, h = (max(1, int(k * n + Fraction(1, 2))) for n in (len(px[0]), len(px)))
        small = by_area(px, w, h)
        left, top = (6 - w) // 2, (4 - h) // 2
        for y in range(4):
            for x in range(6):
                inside = 0 <= y - top < h and 0 <= x - left < w
                want = small[y - top][x - left] if inside else ground
                if ground[3] == 255 and inside:
                    want = (*((2 * (want[3] * c + (255 - want[3]) * g) + 255) // 510 for c, g in zip(want[:3], ground)), 255)
                assert got[i][y][x] == want


def test_ppm_and_images_without_pixels(spark, many):
    files = {r["image_id"]: bytes(r["content"]) for r in resample.ppm(images(spark, many)).collect()}
    for i, px in many.items():
        flat = bytes((2 * (p[3] * p[c] + (255 - p[3]) * 255) + 255) // 510 for row in px for p in row for c in range(3))
        assert files[i] == f"P6\n{len(px[0])} {len(px)}\n255\n".encode() + flat
    none = spark.createDataFrame([(1, 0, 0, b"")], "id long, width int, height int, rgba binary")
    assert resample.ppm(resample.scaled(resample.pixel_rows(none, "id"), F.lit(3), F.lit(3))).count() == 0
