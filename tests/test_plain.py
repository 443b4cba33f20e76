"""Raster operators against the plain versions and values worked by hand, on pictures with and without alpha."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.errors import RangeError
from pixelmill.operators import analysis, auto, display, draw, geometry, resample, stencil
from pixelmill.relation import Pixels
from tests import plain

W, H = 13, 9


def pictures():
    rng = np.random.default_rng(11)
    noise = rng.integers(0, 256, (H, W, 4))
    opaque = noise.copy()
    opaque[..., 3] = 255
    sparse = noise.copy()
    sparse[..., 3] = rng.choice([0, 1, 127, 255], (H, W))
    sparse[..., 2] = 0  # a channel of zeros
    flat = np.full((H, W, 4), (100, 50, 0, 255))
    return {1: noise, 2: opaque, 3: sparse, 4: flat}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, y, x, *map(int, p[y, x])) for i, p in pictures().items() for y in range(H) for x in range(W)]
    spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long").cache().createOrReplaceTempView("plain_pictures")
    return Pixels("SELECT * FROM plain_pictures", W, H)


def arrays(spark, p):
    got = {}
    for r in spark.sql(p.sql).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = (r.r, r.g, r.b, r.a)
    return {i: np.array([[v[y, x] for x in range(p.width)] for y in range(p.height)]) for i, v in got.items()}


def same(spark, p, want, off=0):
    got = arrays(spark, p)
    assert set(got) == set(pictures())
    for i, pic in pictures().items():
        w = want(pic)
        assert got[i].shape == w.shape and np.abs(got[i] - w).max() <= off, (i, np.argwhere(np.abs(got[i] - w) > off)[:4])


def test_worked_blends():
    # 128 of 200 over 64 of 100: alpha (128 * 255 + 64 * 127 + 127) // 255 = 160; (128 * 191 * 200 + 128 * 64 * 200 + 127 * 64 * 100 + 20400) // 40800
    assert plain.blend([100, 100, 100, 64], [200, 200, 200, 128], 128) == [180, 180, 180, 160]
    assert plain.blend([9, 8, 7, 0], [1, 2, 3, 0], 0, "replace") == [9, 8, 7, 0]
    # 60/255 = 0.2353 is below a quarter: 0.2353 + 0.5686 (0.4852 - 0.2353) = 0.3774, times 255 is 96.2; 0.5020 - 0.4980 0.5020 0.4980 = 0.3775
    assert plain.mode_value("soft_light", 200, 60) == 96 and plain.mode_value("soft_light", 64, 128) == 96


@pytest.mark.parametrize("mode", draw.BLENDS)
def test_modes(spark, table, mode):
    same(spark, draw.composite(table, geometry.flip_horizontal(table), mode), lambda p: plain.stamp(p, p[:, ::-1], mode))


def test_composite_places_and_opacity(spark, table):
    small = geometry.crop(table, 2, 1, 5, 4)
    same(spark, draw.composite(table, small, "normal", -2, 3, 0.7), lambda p: plain.stamp(p, p[1:5, 2:7], "normal", -2, 3, 0.7))
    same(spark, draw.composite(table, small, "screen", 1, -2, 0.4, "tile"), lambda p: plain.stamp(p, p[1:5, 2:7], "screen", 1, -2, 0.4, True))
    wide = geometry.expand(table, 1, 2, 2, 1, (1, 2, 3, 90))  # the middle of a larger picture: halves go toward zero
    same(spark, draw.composite(table, wide, draw="center"), lambda p: plain.stamp(p, plain_expand(p), "normal", -1, -1))


def plain_expand(p):
    out = np.full((H + 3, W + 3, 4), (1, 2, 3, 90))
    out[2 : 2 + H, 1 : 1 + W] = p
    return out


def test_shapes(spark, table):
    red, clear = (200, 40, 30, 150), (9, 9, 9, 0)
    box = lambda x, y, w, h: [(i, j) for j in range(y, y + h) for i in range(x, x + w)]
    same(spark, draw.fill_rectangle(table, -2, 3, 6, 4, red), lambda p: plain.draw(p, box(-2, 3, 6, 4), red))
    same(spark, draw.fill_rectangle(table, 1, 1, 6, 4, clear), lambda p: p)
    same(spark, draw.rectangle(table, 2, 1, 7, 5, red), lambda p: plain.draw(p, [q for q in box(2, 1, 7, 5) if q[0] in (2, 8) or q[1] in (1, 5)], red))
    same(spark, geometry.border(table, 2, red), lambda p: plain.draw(p, [(x, y) for x, y in box(0, 0, W, H) if min(x, y, W - 1 - x, H - 1 - y) < 2], red))
    assert draw.line_points(0, 0, 2, 1) == [(0, 0), (1, 0), (2, 1)]
    for ends in ((0, 0, 2, 1), (1, 7, 12, 2), (5, 8, 5, 0), (12, 0, 0, 8), (3, 1, 6, 8)):
        assert draw.line_points(*ends) == plain.line(*ends)
    same(spark, draw.draw_line(table, 1, 7, 12, 2, 1, red), lambda p: plain.draw(p, plain.line(1, 7, 12, 2), red))
    corners = [(1, 1), (11, 2), (6, 8)]
    edges = [q for a, b in zip(corners, corners[1:] + corners[:1]) for q in plain.line(*a, *b)]
    same(spark, draw.polygon(table, *zip(*corners), red), lambda p: plain.draw(p, edges, red))


def test_thick_line_and_round_shapes(spark, table):
    sea = (20, 120, 160, 99)
    near = [(x, y) for y in range(H) for x in range(W) if distance(x, y, 1, 7, 11, 3) <= 1.5]
    same(spark, draw.draw_line(table, 1, 7, 11, 3, 3, sea), lambda p: plain.draw(p, near, sea))
    half = {dy: int(5 * math.sqrt(1 - (dy / 3) ** 2)) for dy in range(-3, 4)}
    disc = [(6 + dx, 4 + dy) for dy, w in half.items() for dx in range(-w, w + 1)]
    same(spark, draw.fill_ellipse(table, 6, 4, 5, 3, sea), lambda p: plain.draw(p, disc, sea))
    rim = [(x, y) for x, y in disc if not {(x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)} <= set(disc)]
    rim += [(6, 1), (6, 7)]  # a row of one pixel at the end is met from both sides
    same(spark, draw.draw_ellipse(table, 6, 4, 5, 3, sea), lambda p: plain.draw(p, rim, sea))


def distance(x, y, x1, y1, x2, y2):
    t = min(1.0, max(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def test_filled_polygon(spark, table):
    xs, ys, sea = [1, 11, 11, 1], [1, 1, 6, 6], (20, 120, 160, 200)
    # vertices name pixels: rows 1 to 5 (half open), columns 1 to 11 with both ends
    inside = [(x, y) for y in range(1, 6) for x in range(1, 12)]
    same(spark, draw.fill_polygon(table, xs, ys, sea, "nonzero", "multiply"), lambda p: plain.draw(p, inside, sea, "multiply"))
    star = geometry.polygon_spans([v + 0.5 for v in (0, 7, 1, 4, 6)], [v + 0.5 for v in (2, 2, 7, 0, 7)], 8)
    assert star[0] == [(4, 4)] and star[1] == [(4, 4)]


def test_coverage(spark, table):
    mask = [(y, x, (40 * x + 60 * y) % 256) for y in range(4) for x in range(5)]
    ink = (200, 40, 30, 220)

    def want(p):
        out = p.copy()
        for y, x, v in mask:
            out[y + 1, x + 2] = plain.blend(out[y + 1, x + 2].tolist(), ink, 220 * v // 255)
        return out

    same(spark, draw.coverage(table, table.values(["y", "x", "v"], mask, "m"), 2, 1, ink), want)


def test_gradients_overwrite(spark, table):
    a, b = (200, 40, 30, 255), (20, 120, 160, 0)
    mix = lambda t: plain.half_up([s + (e - s) * t for s, e in zip(a, b)])
    linear = np.array([[mix(min(1, max(0, ((x - 2) * 8 + (y - 1) * 5) / 89))) for x in range(W)] for y in range(H)])
    same(spark, draw.gradient_linear(table, 2, 1, 10, 6, a, b), lambda p: linear)
    radial = np.array([[mix(min(1, math.hypot(x - 5, y - 4) / 6)) for x in range(W)] for y in range(H)])
    same(spark, draw.gradient_radial(table, 5, 4, 6, a, b), lambda p: radial)
    with pytest.raises(RangeError):
        draw.gradient_linear(table, 3, 3, 3, 3, a, b)

    def faded(p):
        out = p.copy()
        for y in range(H):
            for x in range(W):
                # straight to the left: from the last column, 12 steps to the first
                t = min(1, max(0, ((12 - x) / 12 - 0.25) / 0.5))
                out[y, x, 3] = int(p[y, x, 3] * (1 - t) + 0.5)
        return out

    same(spark, draw.gradient_fade(table, 180, 0.25, 0.75), faded, off=1)


@pytest.mark.parametrize(("w", "h", "kind", "window"), [(26, 18, "catmull_rom", None), (5, 4, "box", None), (5, 4, "catmull_rom", None), (7, 20, "bilinear", None), (6, 6, "catmull_rom", (3.5, 1.25, 6.0, 5.0)), (13, 4, "box", None)])
def test_resize(spark, table, w, h, kind, window):
    same(spark, resample.resize(table, w, h, kind, window), lambda p: plain.resized(p, w, h, kind, window))


def test_cubic_taps_at_the_edge():
    first = [(j, w) for i, j, w in resample.taps(8, 16, "catmull_rom") if i == 0]
    assert first == [(0, 71319), (1, -5783)]


@pytest.mark.parametrize(("mode", "scale", "crop", "canvas"), [
    ("scale_down", (60, 38), None, None), ("scale_up", (80, 50), None, None), ("contain", (60, 38), None, None), ("pad", (60, 38), None, (60, 60, 0, 11)), ("stretch", (60, 60), None, None),
    ("cover", (96, 60), (18, 0, 60, 60), None), ("crop", (80, 50), (10, 0, 60, 50), None), ("fill", (96, 60), (18, 0, 60, 60), None), ("aspect_crop", (80, 50), (10, 0, 60, 50), None),
    ("aspect_cover", (80, 50), (15, 0, 50, 50), None), ("aspect_contain", (80, 50), None, (80, 80, 0, 15)),
])
def test_fit_to_a_square(mode, scale, crop, canvas):
    assert resample.fit_geometry(80, 50, 60, 60, mode) == {"scale": scale, "crop": crop, "canvas": canvas}


def test_fill_never_reduces():
    assert resample.fit_geometry(80, 50, 20, 20, "fill") == {"scale": (80, 50), "crop": (30, 15, 20, 20), "canvas": None}


def test_warps(spark, table):
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    w, h = int(W * c + H * s + 0.5), int(W * s + H * c + 0.5)
    turn = lambda x, y: (W / 2 + c * (x - w / 2) + s * (y - h / 2), H / 2 - s * (x - w / 2) + c * (y - h / 2))
    same(spark, resample.rotate(table, 30, (10, 20, 30, 255)), lambda p: plain.warped(p, w, h, turn, (10, 20, 30, 255)), off=1)
    lean = lambda x, y: ((x - 0.5 * H + 0.5 * y) , y)  # noqa: E731  a factor of -1/2 moves the picture into the canvas
    same(spark, resample.shear(table, -0.5, 0), lambda p: plain.warped(p, int(W + 0.5 * H + 0.5), H, lean), off=1)
    span = math.hypot(W, H) / 2

    def barrel(x, y):
        k = 1 + 0.3 * ((x - W / 2) ** 2 + (y - H / 2) ** 2) / span**2
        return W / 2 + (x - W / 2) * k, H / 2 + (y - H / 2) * k

    same(spark, resample.barrel(table, 0.3), lambda p: plain.warped(p, W, H, barrel), off=1)
    unroll = lambda x, y: (W / 2 + y / H * span * math.sin(x / W * 2 * math.pi - math.pi), H / 2 - y / H * span * math.cos(x / W * 2 * math.pi - math.pi))
    same(spark, resample.polar(table, True), lambda p: plain.warped(p, W, H, unroll), off=1)
    roll = lambda x, y: ((math.atan2(x - W / 2, H / 2 - y) + math.pi) / 2 / math.pi * W, math.hypot(x - W / 2, y - H / 2) / span * H)
    same(spark, resample.polar(table), lambda p: plain.warped(p, W, H, roll), off=1)
    for bend in (60, -90):
        same(spark, resample.arc(table, bend), lambda p, k=bend / 180: plain.warped(p, W, H + int(abs(k) * H / 2), lambda x, y: (x, y - k * H / 2 * ((x - W / 2) / (W / 2)) ** 2)), off=1)


def test_perspective(spark, table):
    quad = [3, 2, 12, 3, 11, 9, 2, 10]
    m = np.array(resample.homography([v - (2 if i % 2 else 2) for i, v in enumerate(quad)], W, H)).reshape(3, 3)
    for (x, y), (u, v) in zip(zip([1, 10, 9, 0], [0, 1, 7, 8]), [(0, 0), (W, 0), (W, H), (0, H)]):
        got = m @ (x, y, 1)
        assert np.allclose(got[:2] / got[2], (u, v))
    place = lambda x, y: tuple((m @ (x, y, 1))[:2] / (m @ (x, y, 1))[2])
    same(spark, resample.perspective(table, quad), lambda p: plain.warped(p, 10, 8, place), off=1)


def test_trails(spark, table):
    at = lambda n: [k / n - 0.5 for k in range(n + 1)]
    line = lambda x, y: [(x + 4 * t * math.cos(0.5), y + 4 * t * math.sin(0.5)) for t in at(4)]
    same(spark, resample.motion_blur(table, 4, math.degrees(0.5)), lambda p: plain.trail(p, line), off=1)
    arc = lambda x, y: [(W / 2 + (x - W / 2) * math.cos(a) - (y - H / 2) * math.sin(a), H / 2 + (x - W / 2) * math.sin(a) + (y - H / 2) * math.cos(a)) for a in (math.radians(12 * t) for t in at(12))]
    same(spark, resample.radial_blur(table, 12), lambda p: plain.trail(p, arc), off=1)
    ray = lambda x, y: [(W / 2 + (x - W / 2) * (1 + 0.2 * t), H / 2 + (y - H / 2) * (1 + 0.2 * t)) for t in at(20)]
    same(spark, resample.zoom_blur(table, 20), lambda p: plain.trail(p, ray), off=1)

    def split(p):
        out, k = p.copy(), 2 / (math.hypot(W, H) / 2)
        for y in range(H):
            for x in range(W):
                dx, dy = (x - W / 2) * k, (y - H / 2) * k
                out[y, x, 0], out[y, x, 2] = plain.bilinear(p, x + dx, y + dy)[0], plain.bilinear(p, x - dx, y - dy)[2]
        return out

    same(spark, resample.chromatic_aberration(table, -2.0), split, off=1)


def test_emboss_unsharp_glow(spark, table):
    def relief(p):
        q = np.pad(p, [(1, 1), (1, 1), (0, 0)], mode="edge")
        k = [(-2, 0, 0), (-1, 0, 1), (-1, 1, 0), (1, 1, 2), (1, 2, 1), (2, 2, 2)]
        out = p.copy()
        out[..., :3] = np.clip(sum(w * q[j : j + H, i : i + W, :3] for w, j, i in k) + 40, 0, 255)
        return out

    same(spark, stencil.emboss(table, 40), relief)
    soft = arrays(spark, stencil.gaussian_blur(table, 1.0))
    sharp, lit = arrays(spark, stencil.unsharp_mask(table, 1.0, 0.8, 3.9)), arrays(spark, stencil.glow(table, 1.0, 1.7))
    for i, p in pictures().items():
        d = p[..., :3] - soft[i][..., :3]
        assert (sharp[i][..., :3] == np.where(np.abs(d) < 3, p[..., :3], plain.half_up(np.round(p[..., :3] + 0.8 * d, 9)))).all()
        base, add = p[..., :3] / 255, 1.7 * soft[i][..., :3] / 255
        assert np.abs(lit[i][..., :3] - plain.half_up(255 * (base + add - base * add))).max() <= 1


def test_drop_shadow(spark, table):
    got = stencil.drop_shadow(table, 2, -1, 0.0)
    assert (got.width, got.height) == (W + 4, H + 3)

    def want(p):
        shade = np.zeros((H + 3, W + 4, 4), int)
        shade[1 : 1 + H, 3 : 3 + W, 3] = p[..., 3]
        base = np.zeros_like(shade)
        base[2 : 2 + H, 1 : 1 + W] = p
        return plain.stamp(shade, base, "normal")

    same(spark, got, want)


def test_automatic_colour(spark, table):
    luma = lambda p: (13933 * p[..., 0] + 46871 * p[..., 1] + 4732 * p[..., 2] + 32768) >> 16

    def gray_world(p):
        m = p[..., :3].reshape(-1, 3).mean(0)
        out = p.copy()
        if m.min() >= 1:
            out[..., :3] = np.clip((p[..., :3] * np.floor(m.mean() / m * 65536 + 0.5).astype(int) + 32768) >> 16, 0, 255)
        return out

    same(spark, auto.auto_color(table), gray_world)
    assert (arrays(spark, auto.auto_color(table))[4][0, 0] == (100, 50, 0, 255)).all()

    def gamma(p):
        m = luma(p).mean()
        out = p.copy()
        if 0 < m < 255:
            out[..., :3] = plain.half_up(np.round(255 * (p[..., :3] / 255) ** (math.log(0.5) / math.log(m / 255)), 6))
        return out

    same(spark, auto.auto_gamma(table), gamma)
    dark = Pixels("SELECT image_id, y, x, 0L AS r, CASE WHEN x = 0 THEN 1L ELSE 0L END AS g, 0L AS b, a FROM plain_pictures", W, H)
    assert (arrays(spark, auto.auto_gamma(dark))[1][0, 0, :3] != (0, 1, 0)).any()  # a mean below 1 is no reason to stay


def test_levels_of_each_colour(spark, table):
    def want(p):
        out = p.copy()
        for c in range(3):
            v = np.sort(p[..., c].ravel())
            skip = int(len(v) * 0.005)
            lo, hi = v[skip], v[len(v) - 1 - skip]
            lo, hi = (lo, hi) if lo < hi else (0, 255)
            out[..., c] = plain.half_up(255 * np.clip((p[..., c] - lo) / (hi - lo), 0, 1))
        return out

    same(spark, auto.auto_levels(table), want)


def test_dehaze(spark, table):
    def want(p):
        low = np.pad(p[..., :3].min(2), 1, mode="edge")
        veil = np.min([low[j : j + H, i : i + W] for j in range(3) for i in range(3)], 0)
        level = sorted(veil.ravel())[-(W * H // 1000 + 1)]
        light = max(1.0, (p[veil >= level][:, :3] @ [0.2126, 0.7152, 0.0722]).mean())
        t = np.maximum(0.1, 1 - 0.7 * 0.95 * veil / light)[..., None]
        out = p.copy()
        out[..., :3] = plain.half_up(np.round((p[..., :3] - light) / t + light, 7))
        return out

    same(spark, auto.dehaze(table, 0.7), want, off=1)


def test_transparency_is_a_matter_of_channels(spark, table):
    assert {r.transparent for r in spark.sql(analysis.is_transparent(table)).collect()} == {1}


def test_feather_counts_colours_only(spark):
    data = np.full((5, 5, 4), (10, 10, 10, 255))
    data[1:4, 1:4] = (18, 10, 10, 100)  # near the seed in colour, far in alpha
    rows = [(1, y, x, *map(int, data[y, x])) for y in range(5) for x in range(5)]
    got = analysis.remove_background(spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long"), 5, 5, 5)
    alpha = {(r.y, r.x): r.a for r in got.where(F.col("a") > 0).collect()}
    assert alpha == {(y, x): 100 if (y, x) == (2, 2) else 100 * 8 // 12 for y in (1, 2, 3) for x in (1, 2, 3)}


def test_display_rectangles_truncate(spark, table):
    got = arrays(spark, display.DisplayList().rect(1.6, 2.7, 3.9, 2.2, (1, 2, 3, 255)).ellipse(9, 4, 0.3, 0.3, (9, 9, 9, 255)).render(table))
    for i, p in pictures().items():
        assert (got[i] == plain.draw(p, [(x, y) for y in (2, 3) for x in (1, 2, 3)], (1, 2, 3, 255))).all()
