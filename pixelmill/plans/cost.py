"""Prices of plans and encoders in microseconds, admission against a budget, and the constrained search of a variant.

Rates are per million pixels or bytes on the machine on which they were measured; calibrate before use elsewhere.
The search is relational: candidates x variants, left joins to two dimension tables, the checks as filters (or a CASE for
the first reason to refuse), and the best by the objective.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.errors import RangeError
from pixelmill.functions import color as C
from pixelmill.operators.resample import pick_filter

# Microseconds for a million pixels, factors in thousandths.
SAMPLE = {"nearest": 29500, "box": 35600, "bilinear": 67300, "catmull_rom": 155100}
COLOR_FIRST, COLOR_MORE, NEIGHBORHOOD = 5200, 700, 42400
ENCODE = {"png": 332880, "jpeg": 18142, "bmp": 6009, "gif": 57618, "tiff": 171493, "webp": 40432, "avif": 114308}
QUALITY_POINTS = (50, 75, 85, 90, 95)
QUALITY = {"jpeg": (727, 868, 1000, 1576, 1899), "webp": (935, 1000, 1101, 1190, 1358), "avif": (852, 1000, 1092, 1175, 1312)}
LOSSLESS_WEBP = (3767, 6609, 10073)
ALPHA = {"png": 1349, "jpeg": 1020, "bmp": 591, "gif": 788, "tiff": 1359, "webp": 1828, "avif": 1004}
FAST_ENCODE = {"png": 599, "webp": 843}
UPPER_DECODE = {"png": 1206, "jpeg": 1251, "bmp": 1046, "gif": 1311, "tiff": 4320, "webp": 2789, "avif": 1228}
UPPER_ENCODE = {"png": 1220, "jpeg": 1362, "bmp": 1077, "gif": 2092, "tiff": 1291, "webp": 1750, "avif": 1247}
REASONS = ("none", "format", "alpha", "uncharacterized", "peak", "quality", "budget")
OBJECTIVES = ("min_bytes", "min_time", "max_quality")


# Reading, in microseconds for a million samples by denominator 1, 2, 4, 8 (in one pass, progressive), and for a
# million compressed bytes; thousandths of a file's bytes that are read; how far a region shortens reading.
DENOMINATORS = (1, 2, 4, 8)
READ = {
    "png": ((5680, 14783, 14333, 13752), (5680, 14783, 14333, 13752)),
    "jpeg": ((5829, 2384, 1554, 475), (6240, 5504, 4285, 947)),
    "bmp": ((5319, 2834, 2036, 1939), (5319, 2834, 2036, 1939)),
    "gif": ((6687, 6373, 5898, 5831), (6687, 6373, 5898, 5831)),
    "tiff": ((4698, 2746, 1975, 1920), (4698, 2746, 1975, 1920)),
    "webp": ((7741, 8751, 7726, 7335), (7741, 8751, 7726, 7335)),
    "avif": ((193612, 195673, 193258, 195634), (193612, 195673, 193258, 195634)),
}
READ_BYTES = {"png": (7907, 7907), "jpeg": (15483, 13199), "tiff": (3986, 3986), "webp": (75758, 75758)}
CONSUMED = {"jpeg": ((987, 987, 987, 987), (996, 996, 994, 212)), "tiff": ((997,) * 4,) * 2, "avif": ((995,) * 4,) * 2}
STORED = {"bmp": 900, "tiff": 900}
REACH = {"png": "rows", "webp": "rows", "gif": "all", "avif": "all"}
FAST_READ = {"jpeg": (902, 1000, 1000, 1000), "webp": (1000, 763, 724, 767), "avif": (389, 382, 380, 378)}
COMPRESSION = {"none": 327, "fast": 606, "best": 1884}
_MOST = (1 << 32) - 1


@dataclass(frozen=True)
class Source:
    """What a file's header says."""

    format: str
    size: int = 0
    channels: int = 3
    progressive: bool = False
    lossless: bool = False


def decode_cost(source: Source, width: int, height: int, region: tuple[int, int, int, int] | None = None, den: int = 1, fast: bool = False, upper: bool = False) -> int:
    """Price of reading a region at a reduction: the samples that are traversed, and the bytes that no reduction saves.

    A format that is read top down is traversed to the region's last row; progressive streams and some formats as a whole.
    Files that are stored without compression have no byte term.
    """
    if source.format not in READ:
        return 0
    x, y, w, h = region or (0, 0, 0, 0)
    x, y = min(x, width), min(y, height)
    w, h = min(w or width, width - x), min(h or height, height - y)
    late, at = int(source.progressive and source.format == "jpeg"), DENOMINATORS.index(den) if den in DENOMINATORS else 0
    reach = "all" if source.progressive else REACH.get(source.format, "region")
    samples = {"all": width * height, "rows": width * (y + h), "region": w * h}[reach]
    total = samples * READ[source.format][late][at] // 1_000_000
    raw = width * height * source.channels
    stored = source.format in STORED and source.size * 1000 >= raw * STORED[source.format]
    if source.format in READ_BYTES and not stored and height:
        taken = source.size * CONSUMED.get(source.format, ((1000,) * 4,) * 2)[late][at] // 1000
        total += (taken * (y + h) // height if reach == "rows" else taken) * READ_BYTES[source.format][late] // 1_000_000
    if fast and not (source.format == "webp" and source.lossless):
        total = total * FAST_READ.get(source.format, (1000,) * 4)[at] // 1000
    return min(_MOST, total * UPPER_DECODE[source.format] // 1000 if upper else total)


def plan_cost(plan, resolution, source: Source | None = None, upper: bool = False) -> int:
    """Price of a resolved plan: reading (with a source), one sampling pass, colour stages, and each neighbourhood pass.

    The passes are priced by the samples of the result; ``upper`` bounds the reading.
    """
    out = resolution.width * resolution.height
    at = lambda rate: out * rate // 1_000_000
    total = decode_cost(source, plan.width, plan.height, resolution.region, resolution.den, plan.fast, upper) if source else 0
    sampled, w, h = 0, plan.width, plan.height
    for op in resolution.ops:
        nw, nh = plan._extent(op, w, h)
        if op.kind in ("resize", "fit") and (nw, nh) != (w, h):
            name = op.args[2] if op.kind == "resize" and len(op.args) > 2 else "auto"
            sampled = max(sampled, *(SAMPLE[pick_filter(name, step, plan.fast)] for step in (w / nw, h / nh)))
        w, h = nw, nh
    total += at(sampled)
    stages = sum(len(C.fuse(what)) if plan.fusion else len(what) for kind, what in plan._segments(resolution.ops) if kind == "color")
    if stages:
        total += at(COLOR_FIRST) + at(COLOR_MORE * (stages - 1))
    total += sum(at(NEIGHBORHOOD) for op in resolution.ops if op.group == "neighborhood")
    return min(_MOST, total)


def encode_price(fmt: str, width: int, height: int, quality: int = 0, lossless: bool = False, compression: str = "auto", alpha: bool = False, fast: bool = False, upper: bool = False) -> int:
    """Price of one encoder; :func:`encode_cost` is the same over columns."""
    pixels = width * height
    cost = pixels * ENCODE.get(fmt, 0) // 1_000_000
    if lossless and fmt == "webp":
        cost = cost * LOSSLESS_WEBP[2 if pixels >= 1_000_000 else 1 if pixels >= 100_000 else 0] // 1000
    elif quality and fmt in QUALITY:
        near = min(range(len(QUALITY_POINTS)), key=lambda i: (abs(quality - QUALITY_POINTS[i]), -i))
        cost = cost * QUALITY[fmt][near] // 1000
    if alpha:
        cost = cost * ALPHA.get(fmt, 1000) // 1000
    if fmt in ("png", "tiff"):
        cost = cost * COMPRESSION.get(compression, 1000) // 1000
    if fast and not (lossless and fmt == "webp"):
        cost = cost * FAST_ENCODE.get(fmt, 1000) // 1000
    return cost * UPPER_ENCODE.get(fmt, 1000) // 1000 if upper else cost


@dataclass(frozen=True)
class Admission:
    """Whether a request fits its budget; prices are scaled by the machine's factor and rounded up."""

    decision: str
    degraded: tuple[str, ...]
    cost_us: int
    cost_upper_us: int
    encode_us: int
    encode_upper_us: int
    margin_us: int


def admit_plan(plan, source: Source, budget_us: int, fmt: str, scale_milli: int = 1000, degrade: bool = False, **encoder) -> Admission:
    """Admit a plan if its upper price fits; with ``degrade`` give up quality until it does."""
    from pixelmill.plans.lattice import rung

    if scale_milli <= 0:
        raise RangeError("scale")
    got, varied = plan.resolve(), plan
    encode, encode_upper = (encode_price(fmt, got.width, got.height, upper=u, **encoder) for u in (False, True))
    limit, decision, lost = budget_us * 1000, "admit", ()
    fits = lambda p, r: (plan_cost(p, r, source, True) + encode_upper) * scale_milli <= limit
    if not fits(plan, got):
        decision = "reject"
        if degrade:
            got, lost, varied = rung(plan, max(1, limit // scale_milli - encode_upper), source, "upper")
            lost = tuple(lost)
            decision = "degraded" if fits(varied, got) else "reject"
    scaled = lambda v: min(_MOST, -(-v * scale_milli // 1000))
    upper = scaled(plan_cost(varied, got, source, True) + encode_upper)
    return Admission(decision, lost, scaled(plan_cost(varied, got, source) + encode), upper, scaled(encode), scaled(encode_upper), budget_us - upper)


def _nearest_quality(q: Column) -> Column:
    out = F.lit(len(QUALITY_POINTS) - 1)
    for i in range(len(QUALITY_POINTS) - 2, -1, -1):
        out = F.when(q * 2 <= QUALITY_POINTS[i] + QUALITY_POINTS[i + 1], i).otherwise(out)
    return out


def _by_format(table: dict, fmt: Column, other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(fmt == k, v).otherwise(out)
    return out.cast("long")


def encode_cost(fmt: Column, width: Column, height: Column, quality: Column, lossless: Column, alpha: Column, fast: Column, upper: bool = False) -> Column:
    """Price of an encoder as an expression over columns, truncated after each factor; 0 for a format without one."""
    pixels = (width * height).cast("long")
    div = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    cost = div(pixels * _by_format(ENCODE, fmt, 0), 1_000_000)
    size = F.when(pixels >= 1_000_000, LOSSLESS_WEBP[2]).when(pixels >= 100_000, LOSSLESS_WEBP[1]).otherwise(LOSSLESS_WEBP[0]).cast("long")
    at = _nearest_quality(quality)
    factor = F.lit(1000).cast("long")
    for k, row in QUALITY.items():
        factor = F.when(fmt == k, F.element_at(F.array(*(F.lit(v).cast("long") for v in row)), at + 1)).otherwise(factor)
    cost = F.when(lossless & (fmt == "webp"), div(cost * size, 1000)).when(quality > 0, div(cost * factor, 1000)).otherwise(cost)
    cost = F.when(alpha, div(cost * _by_format(ALPHA, fmt, 1000), 1000)).otherwise(cost)
    cost = F.when(fast & ~(lossless & (fmt == "webp")), div(cost * _by_format(FAST_ENCODE, fmt, 1000), 1000)).otherwise(cost)
    return div(cost * _by_format(UPPER_ENCODE, fmt, 1000), 1000) if upper else cost


def admit(requests: DataFrame, scale_milli: int = 1000) -> DataFrame:
    """Add ``decision`` to rows with plan_upper_us, encode_upper_us and budget_us: admit where the scaled sum fits."""
    if scale_milli <= 0:
        raise RangeError("scale")
    total = (F.col("plan_upper_us") + F.col("encode_upper_us")).cast("long") * scale_milli
    return requests.withColumn("decision", F.when(total > F.col("budget_us").cast("long") * 1000, "reject").otherwise("admit"))


def select(candidates: DataFrame, variants: DataFrame, lever: DataFrame, encode: DataFrame, objective: str = "min_bytes", min_db: float = 0.0, budget_us: int = 0, peak_cap: int = 1 << 26, alpha: bool = False, refuse_unknown: bool = True) -> DataFrame:
    """One row for each request: the best of candidates x variants that no check refuses, ties in search order.

    candidates: request, candidate, cost_upper_us, peak_bytes, effort, filter, steps; variants: variant, format, quality,
    alpha_ok, allowed, upper_us; lever: format, effort, filter, steps, lever_db; encode: format, quality, bytes_per_pixel,
    encode_db.  A missing row means that a distortion is not characterised.
    """
    if objective not in OBJECTIVES:
        raise RangeError(objective)
    # what does not depend on a request is joined and filtered first, on the small tables
    fits = F.col("allowed") & F.col("alpha_ok") if alpha else F.col("allowed")
    variants = variants.where(fits).join(encode, ["format", "quality"], "left")
    db = F.round(F.least(F.lit(99.0), -10 * F.log10(F.pow(F.lit(10.0), -F.col("lever_db") / 10) + F.pow(F.lit(10.0), -F.col("encode_db") / 10))), 9)
    candidates = candidates.where(F.col("peak_bytes") <= peak_cap)
    if refuse_unknown:
        # every characterised combination is a row of a small table, so requests meet only those that are good enough
        known = variants.join(lever, "format").withColumn("db", db).where(F.col("db").isNotNull() & (F.col("db") >= min_db))
        space = candidates.join(F.broadcast(known), ["effort", "filter", "steps"])  # at most 16 candidates by 18 variants for a request
    else:
        space = candidates.crossJoin(F.broadcast(variants)).join(lever, ["format", "effort", "filter", "steps"], "left").withColumn("db", db)
        space = space.where(F.col("db") >= min_db) if min_db > 0 else space
    space = space.withColumn("total_us", F.col("cost_upper_us") + F.col("upper_us"))
    if budget_us:
        space = space.where(F.col("total_us") <= budget_us)
    size, quality = F.coalesce("bytes_per_pixel", F.lit(3e38)), F.coalesce("db", F.lit(-1.0))
    order = {"min_bytes": [size, F.col("total_us")], "min_time": [F.col("total_us"), size], "max_quality": [-quality, size]}[objective]
    # the least struct is combined before the shuffle; sorting all of a request's rows is not needed
    names = ["candidate", "variant", "format", "quality", "total_us", "bytes_per_pixel", "db"]
    best = space.groupBy("request").agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *names)).alias("best"))
    return best.select("request", *(F.col(f"best.{c}").alias(c) for c in names))


def considered(space: DataFrame, min_db: float = 0.0, budget_us: int = 0, peak_cap: int = 1 << 26, alpha: bool = False) -> DataFrame:
    """Every combination (allowed, alpha_ok, db, peak_bytes, total_us) with the first reason to refuse it, or none."""
    reason = F.when(~F.col("allowed"), "format").when(F.lit(alpha) & ~F.col("alpha_ok"), "alpha").when(F.col("db").isNull(), "uncharacterized")
    reason = reason.when(F.col("peak_bytes") > peak_cap, "peak").when(F.lit(min_db > 0) & (F.col("db") < min_db), "quality")
    return space.withColumn("reason", reason.when(F.lit(budget_us > 0) & (F.col("total_us") > budget_us), "budget").otherwise("none"))
