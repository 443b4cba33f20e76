"""Decisions of the planner, and fused plans against one pass per operation."""

import pytest

from pixelmill.errors import PlanError, RangeError
from pixelmill.functions import color as C
from pixelmill.plans import lattice
from pixelmill.plans.ir import Plan
from pixelmill.raster import Raster
from pixelmill.relation import Pixels


def kinds(plan):
    return [op.kind for op in plan.resolve().ops]


def test_identities_are_dropped():
    plan = Plan(400, 200).brightness(1.0).contrast(1).saturation(1).gamma(1).hue(360).blur(0.3).rotate(360).crop(0, 0, 400, 200).resize(400, 0).curve("levels", 0, 255, 1, 0, 255).curve("exposure", 0).effect("pixelate", 1).matrix(C.IDENTITY).curve("posterize", 256)
    got = plan.resolve()
    assert got.ops == [] and got.eliminated == 14


def test_pairs_merge():
    assert kinds(Plan(400, 200).rotate(90).rotate(270)) == []
    assert kinds(Plan(400, 200).flip_h().brightness(2).flip_h()) == ["brightness"]
    assert kinds(Plan(400, 200).invert().invert()) == []
    assert kinds(Plan(400, 200).grayscale().hue(50).saturation(2)) == ["grayscale"]
    got = Plan(400, 200).crop(10, 20, 100, 100).contrast(2).crop(5, 5, 50, 0).resolve().ops
    assert [(o.kind, o.args) for o in got] == [("crop", (15, 25, 50, 95)), ("contrast", (2,))]
    got = Plan(400, 200).resize(300, 0).resize(0, 75).resolve()
    assert [o.args for o in got.ops] == [(150, 75)] and (got.width, got.height) == (150, 75)


def test_a_neighbourhood_is_a_barrier_and_a_blur_moves_behind_a_reduction():
    assert kinds(Plan(400, 200).flip_h().blur(3).flip_h()) == ["flip_h", "blur", "flip_h"]
    got = Plan(400, 200).gaussian_blur(8).resize(100, 50).resolve().ops
    assert [o.kind for o in got] == ["resize", "gaussian_blur"] and got[1].args == (2.0,)
    assert kinds(Plan(400, 200).gaussian_blur(8).resize(300, 150)) == ["gaussian_blur", "resize"]


def test_reading_gets_the_region_and_the_reduction():
    got = Plan(1600, 1200).crop(0, 0, 800, 800).brightness(1.1).resize(90, 90).resolve()
    assert got.region == (0, 0, 800, 800) and got.den == 8
    assert Plan(400, 200).resize(200, 100).resolve().den == 1
    assert Plan(400, 200).resize(190, 95).resolve().den == 2


def test_colour_is_one_stage_across_mirrors_but_not_across_a_resize():
    assert Plan(400, 200).brightness(1.1).flip_h().contrast(1.2).resolve().stages == 1
    assert Plan(400, 200).brightness(1.1).resize(100, 50).contrast(1.2).resolve().stages == 2


def test_refusals():
    with pytest.raises(RangeError):
        Plan(8, 8).rotate(45)
    with pytest.raises(RangeError):
        Plan(8, 8).resize(0, 0)
    with pytest.raises(RangeError):
        Plan(8, 8).gamma(-1)
    plan = Plan(8, 8)
    for _ in range(32):
        plan.invert()
    with pytest.raises(PlanError):
        plan.invert()


@pytest.mark.parametrize("chain", [
    lambda p: p.crop(1, 0, 6, 7).rotate(90).invert().flip_v().invert(),
    lambda p: p.flip_h().rotate(180).flip_h().crop(1, 1, 4, 4).crop(1, 1, 0, 2),
    lambda p: p.grayscale().saturation(0.4).blur(1).rotate(90).rotate(90),
])
def test_fused_equals_eager(spark, chain):
    rows = [(1, y, x, (31 * x + 7 * y) % 256, (5 * x * y) % 256, 255 - x, 255) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long, a long")
    base = Pixels("SELECT image_id, y, x, r, g, b, a FROM {pixels}", 8, 8)
    both = [sorted(map(tuple, Raster(df, 8, 8, chain(Plan(8, 8, fusion=f)).apply(base)).df.collect())) for f in (True, False)]
    assert both[0] == both[1]


def test_cost_orders_filters():
    price = lambda f: Plan(1000, 1000).resize(500, 500, f).resolve().cost
    assert price("bilinear") < price("catmull_rom") and Plan(1000, 1000).blur(3).resolve().cost > Plan(1000, 1000).invert().resolve().cost


def test_lattice_and_ladder():
    plan = Plan(1600, 1200).resize(300, 225).brightness(1.2)
    found = lattice.enumerate_candidates(plan)
    assert 2 <= len(found) <= 16 and not found[0].fast and found[0].steps == 0
    full, lost = lattice.within_budget(plan, 10**9)
    assert lost == [] and lattice.within_budget(plan, 1)[0].cost <= full.cost
    assert lattice.weakest("exact", "bounded") == "bounded"
    assert lattice.compose_db(None, None) == 99 and abs(lattice.compose_db(40, 40) - 36.9897) < 1e-3
    assert found[0].peak_bytes >= 300 * 225 * 4
