"""One call from files to files: options in a fixed order become a plan, reading gets its region, encoding its format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.errors import RangeError
from pixelmill.operators import geometry, stencil
from pixelmill.plans import cost, lattice
from pixelmill.plans.ir import Plan
from pixelmill.raster import Raster
from pixelmill.relation import Pixels
from pixelmill.sources import images

ORDER = ("crop", "resize", "fit", "rotate", "flip", "brightness", "contrast", "saturation", "hue", "gamma", "grayscale", "invert", "blur", "sharpen", "trim")


def planned(width: int, height: int, **options) -> tuple[Plan, dict]:
    """The plan of the options and what is left for after it (sharpen, trim)."""
    unknown = set(options) - set(ORDER)
    if unknown:
        raise RangeError(f"no such option: {sorted(unknown)}")
    plan, rest = Plan(width, height), {}
    for name in ORDER:
        value = options.get(name)
        if value is None or value is False:
            continue
        if name in ("sharpen", "trim"):
            rest[name] = 8 if name == "trim" and value is True else value
        elif name == "flip":
            plan.add("flip_h" if value == "horizontal" else "flip_v")
        elif name in ("crop", "resize", "fit"):
            plan.add(name, *value)
        elif name in ("grayscale", "invert"):
            plan.add(name)
        else:
            plan.add({"blur": "gaussian_blur"}.get(name, name), value)
    return plan, rest


#: Formats that are tried when none is named: the better artifact first, then by price.
AUTO = ("webp", "jpeg")


def choose_format(width: int, height: int, plan_us: int = 0, budget_us: int | None = None) -> str:
    """The first of the automatic formats that a budget allows behind a plan of a price, else the last; without a budget the first."""
    if budget_us is None:
        return AUTO[0]
    return next((f for f in AUTO if plan_us + cost.encode_price(f, width, height) <= budget_us), AUTO[-1])


def transform(files: DataFrame, width: int, height: int, to: str = "png", colors: int | None = None, budget_us: int | None = None, **options) -> DataFrame:
    """image_id, format, content of files (image_id, content) of one extent; without work to do the bytes pass through.

    Files that are already of the format, with no option that changes a pixel, are not decoded.  The plan's region and
    reduction are handed to the decoders, so pixels that a crop removes never leave them.  ``to`` may be "auto"; with a
    budget the plan gives up quality, rung by rung, until its price and the encoder's fit, if any rung does.
    """
    plan, rest = planned(width, height, **options)
    if to == "auto":
        got = plan.resolve()
        to = choose_format(got.width, got.height, got.cost, budget_us)
    if budget_us is not None:
        got = plan.resolve()
        _, _, plan = lattice.rung(plan, max(1, budget_us - cost.encode_price(to, got.width, got.height)))
    resolved, behind = plan.behind_reading()
    if not resolved.ops and not rest:
        done = files.select("image_id", images.sniffed(F.col("content")).alias("format"), "content").where(F.col("format") == to)
        work = files.where(images.sniffed(F.col("content")) != to)
        return done.unionByName(images.encoded(images.decoded(work), to, colors))
    pixels = images.to_pixels(images.decoded(files, resolved.region, resolved.den))
    p = behind.apply(Pixels("SELECT image_id, y, x, r, g, b, a FROM {pixels}", behind.width, behind.height))
    if "sharpen" in rest:
        p = stencil.sharpen(p, rest["sharpen"])
    if "trim" in rest:
        p = geometry.trim(p, rest["trim"])
    return images.encoded(images.to_dense(Raster(pixels, behind.width, behind.height, p).df), to, colors)


def transform_mixed(files: DataFrame, to: str = "png", most: int = 64, **options) -> DataFrame:
    """:func:`transform` of files of several extents, which their headers tell: one plan for each, all in one query.

    More than ``most`` extents are refused, as every extent is a plan of its own; unreadable files are left out.
    """
    known = images.probed(files).where("error is null").select("image_id", "width", "height")
    extents = [(r.width, r.height) for r in known.select("width", "height").distinct().orderBy("width", "height").limit(most + 1).collect()]
    if len(extents) > most:
        raise RangeError(f"more than {most} extents")
    sized = files.join(known, "image_id")
    parts = [transform(sized.where((F.col("width") == w) & (F.col("height") == h)).select("image_id", "content"), w, h, to, **options).select("image_id", "format", "content") for w, h in extents]
    return reduce(DataFrame.unionByName, parts) if parts else files.select("image_id", F.lit(to).alias("format"), "content").limit(0)


def work(df: DataFrame, name: str = "work"):
    """The pixels with counters that are filled while an action runs: rows, and pixels that are clear or partly so."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counted = df.observe(seen, F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("a") < 255).alias("not_opaque"), F.count_if((F.col("a") > 0) & (F.col("a") < 255)).alias("partial"))
    return counted, seen
