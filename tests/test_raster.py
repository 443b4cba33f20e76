"""Operators against numpy on one picture, worked values, and the fluent interface."""

import math

import numpy as np
import pytest

from pixelmill.errors import BoundsError, RangeError
from pixelmill.functions import color as C
from pixelmill.operators import analysis, geometry, resample
from pixelmill.raster import Raster

W, H = 9, 7


@pytest.fixture(scope="module")
def picture():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, (H, W, 4))
    data[0, 0] = data[0, -1] = data[-1, 0] = data[-1, -1] = (255, 0, 7, 255)
    return data


@pytest.fixture(scope="module")
def raster(spark, picture):
    rows = [(1, y, x, *map(int, picture[y, x])) for y in range(H) for x in range(W)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long").cache()
    return Raster(df, W, H)


def array(r):
    got = r.df.orderBy("y", "x").collect()
    h, w = max(g.y for g in got) + 1, max(g.x for g in got) + 1
    return np.array([[g.r, g.g, g.b, g.a] for g in got]).reshape(h, w, 4)


def cut(x):
    return np.trunc(x).astype(int)


def test_brightness_is_one_rounded_product(raster, picture):
    want = picture.copy()
    want[..., :3] = np.clip(cut((picture[..., :3] * C.fixed(1.3) + 32768) / 65536), 0, 255)
    assert (array(raster.brightness(1.3)) == want).all()


def test_tables_and_presets(raster, picture):
    t = np.array(C.curve("gamma", 2.2))
    assert t[0] == 0 and t[255] == 255 and t[128] == math.floor(255 * (128 / 255) ** 2.2 + 0.5)
    assert (array(raster.gamma(2.2))[..., :3] == t[picture[..., :3]]).all()
    assert C.fuse(C.PRESETS["vivid"]) == [("matrix", C.compose(C.saturation(1.4), C.contrast(1.15)))]
    assert C.curve("negate") == [255 - v for v in range(256)]
    assert array(raster.preset("mono")).shape == (H, W, 4)


def test_geometry(raster, picture):
    assert (array(raster.crop(2, 1, 4, 5)) == picture[1:6, 2:6]).all()
    assert (array(raster.flip_horizontal()) == picture[:, ::-1]).all()
    assert (array(raster.rotate90()) == np.rot90(picture, -1)).all()
    assert (array(raster.rotate270()) == np.rot90(picture)).all()
    assert (array(raster.rotate90().rotate90().rotate180()) == picture).all()
    assert (array(raster.expand(1, 2, 3, 4, (9, 9, 9, 9)))[2 : 2 + H, 1 : 1 + W] == picture).all()
    with pytest.raises(BoundsError):
        raster.crop(W, 0)


def test_trim_cuts_what_it_was_padded_with(raster, picture):
    assert (array(raster.opaque().expand(3, 1, 2, 4, (1, 2, 3, 255)).trim(0))[..., :3] == picture[..., :3]).all()


def blur_axis(a, r, axis):
    p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
    n = a.shape[axis]
    total = sum(np.take(p, range(i, i + n), axis) for i in range(2 * r + 1))
    return (total + r) // (2 * r + 1)


def test_box_blur(raster, picture):
    assert (array(raster.box_blur(2)) == blur_axis(blur_axis(picture, 2, 1), 2, 0)).all()


def test_median_and_morphology(raster, picture):
    p = np.pad(picture, [(1, 1), (1, 1), (0, 0)], mode="edge")
    stack = np.stack([p[i : i + H, j : j + W] for i in range(3) for j in range(3)])
    assert (array(raster.despeckle())[..., :3] == np.sort(stack, 0)[4][..., :3]).all()
    assert (array(raster.dilate(1))[..., :3] == stack.max(0)[..., :3]).all()


def test_halving_by_box_is_the_exact_mean(spark):
    data = np.random.default_rng(1).integers(0, 256, (8, 8))
    rows = [(1, y, x, *[int(data[y, x])] * 3, 255) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long")
    want = (data.reshape(4, 2, 4, 2).sum((1, 3)) * 4 + 8) // 16
    assert (array(Raster(df, 8, 8).resize(4, 4, "box"))[..., 0] == want).all()


@pytest.mark.parametrize("name", ["nearest", "box", "bilinear", "catmull_rom"])
@pytest.mark.parametrize("n", [3, 9, 20])
def test_taps_sum_to_one(name, n):
    sums = {}
    for i, j, w in resample.taps(9, n, name):
        sums[i] = sums.get(i, 0) + w
        assert 0 <= j < 9
    assert sums == {i: 65536 for i in range(n)}


def test_fit_modes():
    assert resample.fit_geometry(80, 50, 60, 60, "cover")["crop"][2:] == (60, 60)
    assert resample.fit_geometry(80, 50, 200, 200, "scale_down")["scale"] == (80, 50)
    assert resample.fit_geometry(80, 50, 40, 40, "contain")["scale"] == (40, 25)
    with pytest.raises(RangeError):
        resample.fit_geometry(8, 8, 4, 4, "none")


def test_composite_over_opaque(raster, picture):
    opaque = raster.opaque()
    got = array(opaque.composite(raster, "normal"))
    a = picture[..., 3:4]
    want = (255 * a * picture[..., :3] + (255 - a) * 255 * picture[..., :3] + 32512) // 65025
    assert (got[..., :3] == want).all() and (got[..., 3] == 255).all()


def test_analysis(raster, picture):
    hist = {r.v: r.n for r in raster.histogram("r").collect()}
    assert [hist[v] for v in range(256)] == np.bincount(picture[..., 0].ravel(), minlength=256).tolist()
    row = raster.average_color().first()
    assert [row.r, row.g, row.b, row.a] == ((picture.reshape(-1, 4).sum(0) + W * H // 2) // (W * H)).tolist()
    assert raster.palette(4).count() == 4
    assert sum(r.members for r in raster.palette(4).collect()) == W * H


def test_background_fill(spark):
    data = np.full((5, 5, 4), (10, 10, 10, 255))
    data[2, 2] = (200, 0, 0, 255)
    rows = [(1, y, x, *map(int, data[y, x])) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long")
    got = analysis.remove_background(df, 5, 5, 10).where("a > 0").collect()
    assert [(r.y, r.x) for r in got] == [(2, 2)]


def test_polygon_spans():
    square = lambda half: geometry.polygon_spans([x + half for x in (0, 4, 4, 0)], [y + half for y in (0, 0, 4, 4)], 8)
    assert square(0) == {y: [(0, 3)] for y in range(4)}  # a continuous path from edge to edge
    assert square(0.5) == {y: [(0, 4)] for y in range(4)}  # vertices that name pixels


def test_span_tests_count_layers():
    assert geometry.span_tests({2: [(1, 4), (3, 6)], 5: [(0, 0)]}) == ["(CASE WHEN y = 2 THEN x BETWEEN 1 AND 6 WHEN y = 5 THEN x BETWEEN 0 AND 0 ELSE false END)", "(CASE WHEN y = 2 THEN x BETWEEN 3 AND 4 ELSE false END)"]
    assert geometry.span_tests({}) == ["false"]
