"""Prices worked by hand, admission, the work clock, reading behind plans, and the choice of formats."""

import numpy as np
import pytest

from pixelmill.errors import BudgetError, RangeError
from pixelmill.operators import detect
from pixelmill.plans import cost, lattice, transform
from pixelmill.plans.cost import Source
from pixelmill.plans.ir import Plan
from pixelmill.plans.work import COUNTERS, Work
from pixelmill.sources import codecs, images


def test_reading_is_priced_by_what_is_traversed():
    # 1000 x 500: the whole, the rows down to 300, and the region of 200 x 100 alone
    assert cost.decode_cost(Source("gif"), 1000, 500, (0, 200, 200, 100)) == 500_000 * 6687 // 1_000_000
    assert cost.decode_cost(Source("webp"), 1000, 500, (0, 200, 200, 100)) == 300_000 * 7741 // 1_000_000
    assert cost.decode_cost(Source("jpeg"), 1000, 500, (0, 200, 200, 100), 8) == 20_000 * 475 // 1_000_000
    assert cost.decode_cost(Source("jpeg", progressive=True), 1000, 500, (0, 200, 200, 100), 8) == 500_000 * 947 // 1_000_000
    # bytes: of a PNG those above the region's end, of a JPEG all that its scans hold
    assert cost.decode_cost(Source("png", 1_000_000), 1000, 500, (0, 0, 0, 250)) == 250_000 * 5680 // 1_000_000 + 500_000 * 7907 // 1_000_000
    assert cost.decode_cost(Source("jpeg", 1_000_000), 1000, 500) == 500_000 * 5829 // 1_000_000 + 987_000 * 15483 // 1_000_000
    assert cost.decode_cost(Source("tiff", 1_400_000), 1000, 500) == 500_000 * 4698 // 1_000_000  # stored as it is
    assert cost.decode_cost(Source("avif"), 1000, 500, fast=True) == (500_000 * 193612 // 1_000_000) * 389 // 1000
    assert cost.decode_cost(Source("png"), 1000, 500, upper=True) == (500_000 * 5680 // 1_000_000) * 1206 // 1000
    assert cost.decode_cost(Source("heif"), 1000, 500) == 0


def test_passes_are_priced_by_the_result():
    plan = Plan(1000, 1000).resize(500, 500, "box").brightness(1.1).gamma(2).blur(3)
    want = 250_000 * 35600 // 1_000_000 + 250_000 * 5200 // 1_000_000 + 250_000 * 700 // 1_000_000 + 250_000 * 42400 // 1_000_000
    assert cost.plan_cost(plan, plan.resolve()) == want
    got, source = plan.resolve(), Source("jpeg", 100_000)
    assert got.den == 2 or got.den == 1
    read = cost.decode_cost(source, 1000, 1000, None, got.den)
    assert cost.plan_cost(plan, got, source) == want + read
    assert cost.plan_cost(plan, got, source, True) == want + read * 1251 // 1000


def test_encoders():
    assert cost.encode_price("png", 1000, 1000) == 332880 and cost.encode_price("png", 1000, 1000, compression="none") == 332880 * 327 // 1000
    assert cost.encode_price("jpeg", 1000, 1000, 80) == 18142  # as near to 75 as to 85: the dearer
    assert cost.encode_price("webp", 100, 100, lossless=True, fast=True) == 404 * 3767 // 1000 and cost.encode_price("heif", 9, 9) == 0
    assert cost.encode_price("webp", 1000, 1000, alpha=True, upper=True) == (40432 * 1828 // 1000) * 1750 // 1000


def test_admission_degrades_only_if_asked():
    plan, source = Plan(2000, 1500).resize(800, 600, "catmull_rom").blur(2), Source("png", 2_000_000)
    free = cost.admit_plan(plan, source, 10**9, "jpeg", quality=85)
    assert free.decision == "admit" and free.degraded == () and free.margin_us == 10**9 - free.cost_upper_us and free.cost_us <= free.cost_upper_us
    tight = free.cost_upper_us - 1
    assert cost.admit_plan(plan, source, tight, "jpeg", quality=85).decision == "reject"
    less = cost.admit_plan(plan, source, tight, "jpeg", degrade=True, quality=85)
    assert less.decision == "degraded" and less.degraded and less.cost_upper_us <= tight
    assert cost.admit_plan(plan, source, 1, "jpeg", degrade=True).decision == "reject"
    assert cost.admit_plan(plan, source, free.cost_upper_us, "jpeg", 2000, quality=85).decision == "reject"
    with pytest.raises(RangeError):
        cost.admit_plan(plan, source, 1, "jpeg", 0)
    with pytest.raises(RangeError):
        lattice.rung(plan, 5, basis="lower")


def test_distortion_tables(spark):
    lever = spark.createDataFrame([(0, "png", 99.0), (1, "gif", 22.7)], "idx int, format string, lever_db double")
    assert lattice.rows(lever, lever.limit(0)) == (2, 0) and lattice.lever_row(lever, 1).first().format == "gif"
    with pytest.raises(RangeError):
        lattice.lever_row(lever, 2)


def test_work_clock(spark):
    w = Work()
    assert len(COUNTERS) == 15 and w.clock_us() == 0 and not w.over_limit()
    w.begin_decode(Source("jpeg", progressive=True))
    w.charge_decode(1000, 1000, None, 8)
    w.merge({"entropy_bytes": 1_000_000, "decoded_samples": 15_625, "resampled": 40_000, "passes": 3, "nothing": 5})
    w.begin_encode("webp", quality=75)
    w.add("encoded", 40_000)
    want = 947 + 13199 + 40_000 * 35600 // 1_000_000 + 40_000 * 2 * 42400 // 1_000_000 + 40_000 * 40432 // 1_000_000
    assert w.clock_us() == want and w.read("passes") == 3 and w.read("nothing") == 0
    w.set_limit(10)
    assert w.clock_us() == 0
    w.check()
    w.add("decode_micros", 11)
    assert w.over_limit()
    with pytest.raises(BudgetError):
        w.check()
    w.set_limit(0)
    assert w.clock_us() == want + 11 and not w.over_limit()
    pixels = spark.createDataFrame([(a,) for a in (0, 7, 254, 255)], "a long")
    assert w.count_alpha(pixels) == 3 and w.count_alpha(pixels, True) == 2 and w.read("alpha_dropped") == 5
    w.reset()
    assert w.clock_us() == 0


def test_reading_does_the_crop_and_the_reduction(spark):
    image = np.random.default_rng(1).integers(0, 256, (64, 48, 3)).astype(np.uint8)
    plan = Plan(48, 64).crop(8, 8, 32, 48).brightness(1.0).resize(7, 0)
    got, behind = plan.behind_reading()
    assert got.region == (8, 8, 32, 48) and got.den == 4 and (behind.width, behind.height) == (8, 12) and [o.args for o in behind.ops] == [(7, 11)]
    files = spark.createDataFrame([(1, codecs.encode(image, "png"))], "image_id long, content binary")
    out = transform.transform(files, 48, 64, to="png", crop=(8, 8, 32, 48), invert=True).first()
    assert (codecs.decode(bytes(out.content))[..., :3] == 255 - image[8:56, 8:40]).all()
    small = codecs.decode(bytes(transform.transform(files, 48, 64, to="bmp", crop=(8, 8, 32, 48), resize=(8, 12)).first().content))
    assert small.shape[:2] == (12, 8)
    assert codecs.decode(codecs.encode(image, "png"), 20).shape[0] == 20
    part = images.decoded(files, (4, 3, 10, 5)).first()
    assert bytes(part.data) == image[3:8, 4:14].tobytes()


def test_format_choice(spark):
    assert transform.choose_format(100, 100) == "webp" and transform.choose_format(1000, 1000, 0, 20_000) == "jpeg" and transform.choose_format(1000, 1000, 0, 1) == "jpeg" and transform.choose_format(1000, 1000, 0, 10**6) == "webp"
    files = spark.createDataFrame([(1, codecs.encode(np.full((6, 8, 3), 9, np.uint8), "png"))], "image_id long, content binary")
    assert transform.transform(files, 8, 6, to="auto", invert=True).first().format == "webp"
    assert transform.transform(files, 8, 6, to="jpeg", budget_us=1, resize=(4, 3)).first().format == "jpeg"
    with pytest.raises(RangeError):
        images.with_quality(files, 101)
    assert images.with_quality(files, 80).first().quality == 80


def test_fit_around_a_focus(spark):
    rows = [(i, y, x, x, y, 0, 255) for i in (1, 2, 3) for y in range(4) for x in range(12)]
    pixels = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long")
    where = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.8, 0.5)], "image_id long, fx double, fy double")
    got = {}
    for r in detect.focused_fit(pixels, (12, 4), (4, 4), "cover", where).collect():
        got.setdefault(r.image_id, set()).add((r.x, r.r))
    left = {i: min(v for x, v in s if x == 0) for i, s in got.items()}
    assert left == {1: 0, 2: 8, 3: 4} and all({x for x, _ in s} == {0, 1, 2, 3} for s in got.values())


def test_files_of_several_extents(spark):
    rng = np.random.default_rng(3)
    pictures = {1: rng.integers(0, 256, (6, 8, 3)), 2: rng.integers(0, 256, (9, 5, 3)), 3: rng.integers(0, 256, (6, 8, 3))}
    files = spark.createDataFrame([(i, codecs.encode(p.astype(np.uint8), "png" if i < 3 else "webp")) for i, p in pictures.items()] + [(9, b"no picture")], "image_id long, content binary")
    got = {r.image_id: codecs.decode(bytes(r.content)) for r in transform.transform_mixed(files, to="bmp", crop=(1, 1, 3, 4), invert=True).collect()}
    assert set(got) == set(pictures)
    for i, p in pictures.items():
        assert (got[i][..., :3] == 255 - p[1:5, 1:4]).all()
    with pytest.raises(RangeError):
        transform.transform_mixed(files, most=1)
