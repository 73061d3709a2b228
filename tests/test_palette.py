"""Median cut, best box first, against the loop over one box at a time."""

import math
import random

from pyspark.sql import functions as F

from docloom.operators import pixels


def step_by_step(rows, colors):
    """rows: (r, g, b, a) of one image; palette with populations by index."""
    clear = int(any(a < 128 for *_, a in rows))
    hist = {}
    for r, g, b, a in rows:
        if a >= 128:
            key = (r >> 3, g >> 3, b >> 3)
            hist[key] = hist.get(key, 0) + 1
    if not hist:
        return {clear: (0, 0, 0, 0)}
    found = [sorted(hist)]

    def facts(box):
        spans = [max(k[c] for k in box) - min(k[c] for k in box) for c in range(3)]
        axis = spans.index(max(spans))
        return axis, spans[axis] * math.sqrt(sum(hist[k] for k in box))

    while len(found) < max(2, colors - clear):
        scores = [facts(b)[1] for b in found]
        if max(scores) == 0:
            break
        at = scores.index(max(scores))
        box = sorted(found[at], key=lambda k: k[facts(found[at])[0]])
        half, total, cut = sum(hist[k] for k in box) / 2, 0, 0
        while total < half:
            total += hist[box[cut]]
            cut += 1
        cut = min(cut, len(box) - 1)
        found[at : at + 1] = [box[:cut], box[cut:]]
    out = {}
    for i, box in enumerate(found):
        n = sum(hist[k] for k in box)
        out[i + clear] = (*(math.floor(sum((k[c] << 3 | k[c] >> 2) * hist[k] for k in box) / n + 0.5) for c in range(3)), n)
    return out


def test_median_cut(spark):
    rng = random.Random(4)
    images = {i: [(*(min(255, max(0, int(rng.gauss(m, s)))) for m in rng.choice([(40, 90, 200), (200, 10, 10), (120, 120, 120)])), 255) for _ in range(400)] for i, s in enumerate([3, 20, 60, 120])}
    images[1] = [(r, g, b, rng.choice([0, 127, 128, 255])) for r, g, b, _ in images[1]]
    images[4] = [(x * 8, y * 8, 0, 255) for x in range(32) for y in range(32)]  # ties without end
    images[5] = [(9, 9, 9, 255)] * 5
    images[6] = [(9, 9, 9, 0)] * 5
    images[7] = [(0, 0, 0, 255)] * 1000 + [(255, 0, 0, 255), (255, 255, 0, 255)]  # half lies in the first colour
    images[8] = [(1 << i, 0, 0, 255) for i in range(8) for _ in range(4 ** (7 - i))]  # a long chain of cuts
    rows = [(i, *p) for i, ps in images.items() for p in ps]
    df = spark.createDataFrame(rows, "image_id int, r int, g int, b int, a int").repartition(3)
    for colors in (2, 6, 17):
        got = {(r["image_id"], r["idx"]): (r["r"], r["g"], r["b"], r["n"]) for r in pixels.median_cut(df, colors).collect()}
        want = {(i, idx): v for i, ps in images.items() for idx, v in step_by_step(ps, colors).items()}
        assert got == want
    assert pixels.median_cut(df.limit(0), 4).count() == 0


def test_box_statistics(spark):
    rows = [(1, 0, 31 << 10, 3), (1, 0, 1 << 5, 1), (1, 1, 5, 2), (1, 1, 7, 2)]
    got = pixels.box_statistics(spark.createDataFrame(rows, "image_id int, box int, color int, n long")).orderBy("box").select("pop", "n_colors", "r_max", "axis", "span", "score").collect()
    assert [tuple(r) for r in got] == [(4, 2, 31, 0, 31, 62.0), (4, 2, 0, 2, 2, 4.0)]
