"""Pictures made and looked at in one worker, and kernels against their plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold import plans
from quirefold.operators import pixels as X

SF = "/root/testdata/sf0.001"


def noisy(seed, h=90, w=130):
    rng = np.random.default_rng(seed)
    img = rng.integers(180, 256, (h, w)).astype(np.uint8)
    img[20:24, 9:-9] = img[50:53, 9:-9] = img[70:72, 20:-4] = rng.integers(0, 60)
    return img


def test_equal_pictures_are_reckoned_once():
    calls = []
    of = X.remembered(lambda i: calls.append(1) or int(i.sum()), most=3 * 12)
    a, b = bytes(range(12)), bytes(range(1, 13))
    assert [of(3, 4, a), of(3, 4, b), of(4, 3, a), of(3, 4, bytearray(a))] == [66, 78, 66, 66] and len(calls) == 3
    assert [of(3, 4, bytes([k] * 12)) for k in range(9)] == [12 * k for k in range(9)] and of(3, 4, a) == 66 and len(calls) == 13


def test_looked_at_keeps_keys_and_nulls(spark):
    keys = spark.range(3000).select((F.col("id") % 7).alias("k"))
    got = X.looked_at(keys, lambda k: np.full((2, 3), k, np.uint8), lambda i: (int(i.sum()) or None, i[0].tolist()), "n long, row array<int>")
    assert {(r.k, r.n, tuple(r.row)) for r in got.collect()} == {(k, 6 * k or None, (k,) * 3) for k in range(7)} and got.count() == 3000


def pages_stay_in_their_worker(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "data#" not in plan


@pytest.mark.parametrize("seed", range(5))
def test_skew_by_the_whole_spectrum(seed):
    img = X.rotate(noisy(seed), 3.0 * seed - 7)
    for q in (10, 33.3, 50, 85, 100):
        assert X.percentile(img, q) == np.percentile(img, q)
    ink = (img < np.percentile(img, 85)).astype(np.float64)
    square = np.zeros((256, 256))
    square[: ink.shape[0], : ink.shape[1]] = ink - ink.mean()
    power = np.abs(np.fft.fftshift(np.fft.fft2(square)))
    angles, radius = np.linspace(-15, 15, 600), np.arange(16, 127)
    a = np.deg2rad(angles)[:, None]
    strength = power[np.rint(128 + radius * np.cos(a)).astype(int), np.rint(128 - radius * np.sin(a)).astype(int)].sum(1)
    at = np.abs(angles - X.skew(img)).argmin()
    assert strength[at] >= strength.max() * (1 - 1e-5)


@pytest.mark.parametrize("degrees", [-20.0, 0.06, 4.0, 90.0])
def test_rotation_by_its_formula(degrees):
    img = noisy(2, 150, 90)  # several blocks of rows
    h, w = img.shape
    y, x = np.mgrid[:h, :w].astype(np.float32)
    c, s, cx, cy = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees)), (w - 1) / 2, (h - 1) / 2
    sx, sy = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    far = np.pad(img.astype(float), 200, constant_values=255)
    at = lambda i, j: far[y0 + i + 200, x0 + j + 200]
    fx, fy = sx - x0, sy - y0
    want = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    assert (X.rotate(img, degrees) == np.clip(np.rint(want), 0, 255)).all()


@pytest.mark.parametrize("half", [1, 8])
def test_background_by_its_formula(half):
    img, k = noisy(1), 2 * half + 1
    around = np.lib.stride_tricks.sliding_window_view(np.pad(img.astype(float), half, mode="edge"), (k, k)).mean((2, 3))
    assert (X.divide_background(img, half) == np.clip(img / (around + 1e-5) * 255, 0, 255).astype(np.uint8)).mean() > 0.999


def test_equal_files_are_read_once_in_a_batch(spark):
    seen = spark.sparkContext.accumulator(0)
    of = X.over_images(lambda i: seen.add(1) or int(i.sum()), "long")
    got = spark.range(100).coalesce(1).select(of(F.lit(1), F.lit(3), F.lit(b"abc"))).collect()
    assert {r[0] for r in got} == {294} and seen.value < 100


# by finding: F1
@pytest.mark.parametrize("name", ["mth_12", "img_02", "img_03", "img_04", "img_06", "img_18", "img_07", "img_20", "img_01", "img_05", "img_13"])
def test_pages_stay_in_their_worker(spark, name):
    assert pages_stay_in_their_worker(spark, name)
