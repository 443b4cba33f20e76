"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target of tokens.  Among all rates of its documents from 0 to ``cap`` that meet the target, the ones of
least relative entropy against one copy of each are exponentially tilted by the documents' sizes: the odds rate : (cap -
rate) are those of one copy, times exp(lambda x), where x is the document's size over its source's mean.  The dual is convex
in the sources' lambdas.  Newton steps run on all documents at once: the gradient (tokens at the present rates less the
target) and the Hessian of each source come from one aggregation over all documents a step, pre-aggregated once to the
number of documents of each source and size, of which the rate is a function.  A step that leaves the interval in which the
solution is known to lie halves that interval instead.  Steps stop when every source is within half a token.  All sums are
of decimals, so they do not depend on the order of rows.

Rates are rounded into whole copies without a random number.  First, systematic rounding: documents stand in an order
fixed by hashes, and a document gets the number of multiples of one that its interval of accumulated rates holds, floor or
ceil of its rate.  Then what a source's copies miss of its target is made up by one copy more (or less) of some documents:
first of documents in the order of a hash of at most an eighth of what is missing, then, for the little that is left, of
the shortest.  No document gets more than ``cap`` copies.  Orders need prefix sums within a source, which may hold a third
of all rows: see :func:`pixelmill.llm.common.prefix_sums`.

Null texts have size 0; the null source is a source of its own and comes last.  A document of size 0 has the rate of one
copy but adds no token.  An empty table gives an empty result.  Rows with the same doc_id are separate rows; equal rows may
get different numbers of copies.  Texts are counted whole, whatever their length; columns besides those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import forget, prefix_sums, small, written

# Fixed value: a word is a maximal run of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 25
#: Rows of sources and sizes that are one task's work.
_ALONE = 500_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets of sources (source, source_size): weights in turn by code point with null last, a share of all sizes.

    A target stops at ``cap`` times its source's size; the excess is shared again by weight until none is above.  That
    fixed point fills the sources with the smallest cap per weight first, so running sums in that order give the level.
    The windows run over the table of sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level)
    free = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("most"), F.coalesce(free, F.lit(float("inf"))) * F.col("weight"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def tilted(size: Column, mean: Column, lam: Column, cap: int) -> Column:
    """The rate of documents of a size at lambda: ``cap`` times a logistic function that is 1 (cap / 2 if less) at 0."""
    least = min(1.0, cap / 2)
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(F.lit(math.log((cap - least) / least)) - lam * size / mean))


def _newton(sizes: DataFrame, state: DataFrame, cap: int, within: float) -> DataFrame:
    """The state after one step; every source has a size, so the join keeps all of them."""
    exact = lambda x: F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double")
    held = ["source_size", "target", "mean", "lam", "lo", "hi"]
    x = sizes.join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rate = tilted(F.col("size"), F.col("mean"), F.col("lam"), cap)
    mass = F.col("n") * F.col("size") * rate
    now = x.groupBy("source").agg(*(F.first(c).alias(c) for c in held), exact(mass).alias("_f"), exact(mass * F.col("size") / F.col("mean") * (1 - rate / float(cap))).alias("_g"))
    miss = F.col("_f") - F.col("target")
    lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
    now = now.select("source", "source_size", "target", "mean", "lam", lo.alias("lo"), hi.alias("hi"), miss.alias("residual"), F.when(F.col("_g") > 0, -miss / F.col("_g")).alias("step"))
    inner = F.when(F.col("hi") == float("inf"), F.col("lo") + 4).when(F.col("lo") == float("-inf"), F.col("hi") - 4).otherwise((F.col("lo") + F.col("hi")) / 2)
    to = F.col("lam") + F.col("step")
    moved = F.when((to > F.col("lo")) & (to < F.col("hi")) & (F.abs("step") <= 4), to).otherwise(inner)
    lam = F.when(F.abs("residual") <= within, F.col("lam")).when(F.col("lam").isNotNull(), moved)
    return now.select("source", "source_size", "target", "mean", lam.alias("lam"), "lo", "hi", "residual")


def balanced(sizes: DataFrame, targets: DataFrame, cap: int, within: float = 0.5) -> DataFrame:
    """source, source_size, target, mean, lam and residual (tokens at the rates less the target) for every source.

    ``sizes`` are the numbers ``n`` of documents of each source and size.  A source without tokens or whose target is 0
    has no lambda, nor has one whose target is ``cap`` times its size: rates are 0, or all ``cap``.
    """
    documents = sizes.where("size > 0").groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("_n"))
    state = targets.join(documents, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    free = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < F.lit(float(cap)) * F.col("source_size"))
    state = state.select("source", "source_size", "target", (F.col("source_size") / F.col("_n")).alias("mean"), F.when(free, F.lit(0.0)).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(None).cast("double").alias("residual"))
    # a table that fits in one task's batch stays in one: its aggregations then need no exchange
    if sizes.limit(_ALONE + 1).count() <= _ALONE:
        sizes, state = sizes.coalesce(1), state.coalesce(1)
    state = written(state, "mix-dual")
    for _ in range(_STEPS):
        now = state
        for _ in range(4):
            now = _newton(sizes, now, cap, within)
        before, state = state, written(now, "mix-dual")
        forget(before)
        if not state.where(F.abs("residual") > within).limit(1).count():
            break
    return state


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = (5, 2, 1), carry: list[str] | None = None) -> DataFrame:
    """Copies of each document of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size (words), source_size, target, rate, copies (0 to ``cap``), taken (copies times size)
    and the columns named in ``carry``.
    """
    carry = carry or []
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", "source", "doc_id").alias("_mark"), *(F.col(c).alias(f"_c_{i}") for i, c in enumerate(carry)))
    slim = written(slim, "mix-rows")
    sizes = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    state = balanced(sizes, source_targets(sums, share, cap, weights), cap)
    forget(sizes)
    near = small(state.select(F.col("source").alias("_source"), "source_size", "target", "mean", "lam"))
    dealt = slim.join(near, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.lit(float(cap))).otherwise(F.lit(0.0))
    rate = F.when(F.col("lam").isNull(), whole).otherwise(tilted(F.col("size"), F.col("mean"), F.col("lam"), cap))
    dealt = dealt.withColumn("rate", rate).drop("lam", "mean")

    # Systematic rounding in an order that mixes hashes within lengths: integers of 1e-9 keep the sums exact in any order.
    unit = 1_000_000_000
    dealt = dealt.withColumn("_r", F.round(F.col("rate") * unit).cast("long"))
    order = [F.col("_mark"), F.col("doc_id"), F.col("size")]
    octave = F.floor(F.log2(F.col("size") + 1) * 4)
    first = prefix_sums(dealt, ["source"], -octave, order, F.col("_mark"), {"_at": F.col("_r")}, rows)
    half = F.lit(unit // 2)
    copies = F.floor((F.col("_at") + F.col("_r") + half) / unit) - F.floor((F.col("_at") + half) / unit)
    got = written(first.withColumn("copies", F.least(F.lit(cap), copies).cast("int")).drop("_at", "_r"), "mix-first")
    forget(slim)
    got = written(_made_up(got, cap, F.lit(0), order, 8, rows), "mix-second")
    got = _made_up(got, cap, octave, [F.col("size"), *order], 1, rows)
    return got.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(F.col(f"_c_{i}").alias(c) for i, c in enumerate(carry))
    )


def _made_up(rows: DataFrame, cap: int, coarse: Column, order: list[Column], part: int, count: int) -> DataFrame:
    """One copy more (or less) of documents in an order, each of at most 1 / ``part`` of what its source misses, while they fit."""
    gaps = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_gap"))
    gaps = small(written(gaps, "mix-gaps")).withColumnRenamed("source", "_source")
    wide = rows.join(gaps, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    able = (F.col("size") > 0) & F.when(F.col("_gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    room = F.when(able & (F.col("size") * part <= F.abs("_gap")), F.col("size")).otherwise(F.lit(0))
    summed = prefix_sums(wide.withColumn("_room", room), ["source"], coarse, order, F.col("_mark"), {"_used": F.col("_room")}, count)
    change = F.when((F.col("_room") > 0) & (F.col("_used") + F.col("_room") <= F.abs("_gap")), F.signum("_gap")).otherwise(F.lit(0)).cast("int")
    return summed.withColumn("copies", (F.col("copies") + change).cast("int")).drop("_gap", "_room", "_used")
