"""Cheaper versions of a plan: the lattice of levers, the budget ladder, bounds of memory, and distortion arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pixelmill.errors import RangeError
from pixelmill.plans import cost
from pixelmill.plans.ir import Op, Plan, Resolution

MAX_CANDIDATES = 16
# Classes of knowledge about a distortion, the strongest first; the cap of a level in dB.
CLASSES = ("exact", "measured", "bounded", "uncharacterized")
MAX_DB = 99.0


@dataclass(frozen=True)
class Candidate:
    fast: bool
    nearest: bool
    steps: int  # halvings of the size that is sampled from
    resolution: Resolution
    peak_bytes: int


def weakest(a: str, b: str) -> str:
    return max(a, b, key=CLASSES.index)


def compose_db(lever_db: float | None, encode_db: float | None) -> float:
    """Noise powers add; None stands for an exact step."""
    noise = sum(10 ** (-x / 10) for x in (lever_db, encode_db) if x is not None)
    return MAX_DB if noise <= 0 else min(MAX_DB, -10 * math.log10(noise))


def peak_bytes(plan: Plan, resolution: Resolution) -> int:
    """Bytes that must be held at once: a pass's input and output, the scan's reduced region first."""
    w, h = resolution.region[2:] if resolution.region else (plan.width, plan.height)
    w, h, channels = -(-w // resolution.den), -(-h // resolution.den), plan.channels
    held = most = w * h * channels
    for op in resolution.ops:
        w2, h2 = plan._extent(op, w, h)
        out = w2 * h2 * channels
        most = max(most, held + out)
        held, w, h = out, w2, h2
    return most


def _varied(plan: Plan, fast: bool, nearest: bool, steps: int) -> Plan:
    """The plan under some levers: the fast effort, nearest taps, and sampling from 1/2^steps of the size."""
    out = Plan(plan.width, plan.height, plan.channels, plan.fusion, fast or plan.fast, plan.background)
    ops = [replace(o, args=(*o.args[:2], "nearest")) if nearest and o.kind == "resize" else o for o in plan.ops]
    first = next((i for i, o in enumerate(ops) if o.kind in ("resize", "fit")), None)
    if steps and first is not None:
        w, h = plan.width, plan.height
        for o in ops[:first]:
            w, h = plan._extent(o, w, h)
        small = (max(1, -(-w >> steps)), max(1, -(-h >> steps)))
        target = plan._extent(ops[first], w, h)
        if ops[first].kind == "resize" and small[0] >= 1 and small != target:
            ops.insert(first, Op("resize", (*small, "box")))
            out.fusion = False  # the two resizes are the point
    out.ops = ops
    return out


def enumerate_candidates(plan: Plan) -> list[Candidate]:
    """Effort x filter x steps, without those that come to the same; at most sixteen, the full plan first."""
    out: list[Candidate] = []
    for fast in (False, True):
        for nearest in (False, True):
            for steps in range(4):
                version = _varied(plan, fast, nearest, steps)
                got = version.resolve()
                if not any(c.resolution == got and c.fast == fast for c in out) and len(out) < MAX_CANDIDATES:
                    out.append(Candidate(fast, nearest, steps, got, peak_bytes(version, got)))
    return out


def within_budget(plan: Plan, micros: int, source: cost.Source | None = None, basis: str = "point") -> tuple[Resolution, list[str]]:
    """The first rung of the ladder that fits a budget, and what it gave up; the cheapest if none does."""
    return rung(plan, micros, source, basis)[:2]


def rung(plan: Plan, micros: int, source: cost.Source | None = None, basis: str = "point") -> tuple[Resolution, list[str], Plan]:
    """Like :func:`within_budget`, with the rung's plan.

    Rungs: the plan, the fast effort, nearest taps, then one to three halvings; a rung that is not cheaper is skipped.
    ``basis`` tells which price must fit, the point or the upper one.
    """
    if basis not in ("point", "upper"):
        raise RangeError(basis)
    rungs = [(False, False, 0, []), (True, False, 0, ["effort"]), (True, True, 0, ["effort", "filter"]), *((True, True, s, ["effort", "filter", "scale"]) for s in (1, 2, 3))]
    best, least = None, 0
    for fast, nearest, steps, lost in rungs:
        version = _varied(plan, fast, nearest, steps)
        got = version.resolve()
        price = cost.plan_cost(version, got, source, basis == "upper")
        if best is None or price < least:
            got.degraded = lost
            best, least = (got, lost, version), price
        if least <= micros or not micros:
            break
    return best


def rows(lever: DataFrame, encode: DataFrame) -> tuple[int, int]:
    """Row counts of the two tables of distortions."""
    return lever.count(), encode.count()


def lever_row(lever: DataFrame, index: int) -> DataFrame:
    """One row of a table of lever distortions that has the column idx; an index outside is an error."""
    got = lever.where(F.col("idx") == index)
    if index < 0 or not got.limit(1).count():
        raise RangeError("index")
    return got


def select_ladder(chosen: DataFrame, source_format: str) -> DataFrame:
    """Of ranked candidates (request, format, steps, total_us, ...), the first in search order of the source's own format."""
    first = Window.partitionBy("request").orderBy("candidate", "variant")
    return chosen.where(F.col("format") == source_format).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def select_independent(space: DataFrame) -> DataFrame:
    """First the format of the fewest bytes, whatever the time, then the quickest candidate of it."""
    by_size = Window.partitionBy("request").orderBy(F.col("bytes_per_pixel").asc_nulls_last(), "variant")
    formats = space.withColumn("_k", F.row_number().over(by_size)).where("_k = 1").select("request", "format")
    quick = Window.partitionBy("request").orderBy("total_us", "candidate", "variant")
    return space.join(formats, ["request", "format"]).withColumn("_k", F.row_number().over(quick)).where("_k = 1").drop("_k")
