"""Measures of images: aggregates that end in a small row for each image."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.color import check
from pixelmill.relation import CHANNELS, Pixels, luma, num
from pixelmill.sources.images import image_array


def average_color(p: Pixels) -> str:
    """image_id and the rounded mean of each channel."""
    body = ", ".join(f"{p.div(f'CAST(sum({c}) AS BIGINT) + {p.div("count(*)", "2")}', 'count(*)')} AS {c}" for c in CHANNELS)
    return f"SELECT image_id, {body} FROM ({p.sql}) t GROUP BY image_id"


def get_pixel(p: Pixels, x: int, y: int) -> Pixels:
    return p.select(where=f"x = {x} AND y = {y}")


def is_transparent(p: Pixels) -> str:
    """image_id, transparent: whether the images have an alpha channel, whatever is in it."""
    return f"SELECT image_id, CAST({int(p.channels in (2, 4))} AS BIGINT) AS transparent FROM ({p.sql}) t GROUP BY image_id"


def integral_image(p: Pixels) -> str:
    """image_id, y, x, s: sums of luma over all pixels to the left of and above a place, itself included."""
    inner = f"SELECT image_id, y, x, CAST(sum({luma()}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM ({p.sql}) t"
    return f"SELECT image_id, y, x, CAST(sum(s) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM ({inner}) u"


def focus_auto(p: Pixels, tiles: int = 16) -> str:
    """image_id, fx, fy in 0 to 1: the centroid of luma differences to the right and below, by tiles; the middle if flat."""
    lit = f"(SELECT image_id, y, x, {luma()} AS l FROM ({p.sql}) t)"
    moved = f"(SELECT *, lead(l) OVER (PARTITION BY image_id, y ORDER BY x) AS rt, lead(l) OVER (PARTITION BY image_id, x ORDER BY y) AS dn FROM {lit} u)"
    weights = f"(SELECT image_id, {p.div(f'x * {tiles}', str(p.width))} AS tx, {p.div(f'y * {tiles}', str(p.height))} AS ty, CAST(sum(abs(l - rt) + abs(l - dn)) AS BIGINT) AS w FROM {moved} v WHERE rt IS NOT NULL AND dn IS NOT NULL GROUP BY 1, 2, 3)"
    centroid = lambda c: f"CASE WHEN sum(w) > 0 THEN round(CAST(sum(w * (2 * {c} + 1)) AS DOUBLE) / CAST(sum(w) AS DOUBLE) / {num(2 * tiles)}, 9) ELSE 0.5e0 END"
    return f"SELECT image_id, {centroid('tx')} AS fx, {centroid('ty')} AS fy FROM {weights} k GROUP BY image_id"


def _cells(extent: int, n: int = 32) -> list[tuple[int, int]]:
    """(cell, place) pairs of the reduction to n cells; a cell has at least one place."""
    out = []
    for i in range(n):
        a, b = i * extent // n, (i + 1) * extent // n
        out += [(i, j) for j in range(a, min(extent, max(b, a + 1)))]
    return out


def phash(p: Pixels) -> str:
    """image_id, hash: 64 bits, row by row from the most significant, of an 8 x 8 cosine block above its median without DC.

    Luma is averaged in 32 x 32 cells, then each coefficient is a sum of products with two cosine tables in 1e-9 units,
    so that all engines compare equal integers with equal integers.
    """
    cos = [(u, x, round(math.cos(math.pi * u * (x + 0.5) / 32) * 1_000_000)) for u in range(8) for x in range(32)]
    cx, cy = p.values(["gx", "x"], _cells(p.width), "cx"), p.values(["gy", "y"], _cells(p.height), "cy")
    grid = f"(SELECT t.image_id, cy.gy, cx.gx, {p.div(f'CAST(sum({luma("t.r", "t.g", "t.b")}) AS BIGINT) * 1000', 'count(*)')} AS l FROM ({p.sql}) t JOIN {cx} ON cx.x = t.x JOIN {cy} ON cy.y = t.y GROUP BY 1, 2, 3)"
    kx, ky = p.values(["u", "gx", "c"], cos, "kx"), p.values(["v", "gy", "c"], cos, "ky")
    rows = f"(SELECT g.image_id, g.gy, kx.u, CAST(sum(g.l * kx.c) AS BIGINT) AS s FROM {grid} g JOIN {kx} ON kx.gx = g.gx GROUP BY 1, 2, 3)"
    block = f"(SELECT w.image_id, ky.v, w.u, CAST({p.div('CAST(sum(CAST(' + p.div('w.s', '1000') + ' AS BIGINT) * ky.c) AS BIGINT)', '1000')} AS BIGINT) AS s FROM {rows} w JOIN {ky} ON ky.gy = w.gy GROUP BY 1, 2, 3)"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY image_id, CASE WHEN u = 0 AND v = 0 THEN 0 ELSE 1 END ORDER BY s) AS k FROM {block} b)"
    middle = f"(SELECT image_id, s AS m FROM {ranked} r WHERE k = 32 AND NOT (u = 0 AND v = 0))"
    # bit 63 is the sign: its weight is the least 64-bit integer
    weights = [(v, u, (1 << (63 - 8 * v - u)) if v or u else -(1 << 63) + 1) for v in range(8) for u in range(8)]
    powers = p.values(["v", "u", "p"], [(v, u, w) for v, u, w in weights], "w")
    # the sum of the top weight plus one and the rest stays in range: at most 2**63 - 1 below zero's side
    return (
        f"SELECT b.image_id, CAST(sum(CASE WHEN b.s > m.m THEN CAST(w.p AS DECIMAL(38,0)) ELSE 0 END) - max(CASE WHEN b.s > m.m AND w.v = 0 AND w.u = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hash "
        f"FROM {block} b JOIN {middle} m ON m.image_id = b.image_id JOIN {powers} ON w.v = b.v AND w.u = b.u GROUP BY b.image_id"
    )


def phash_distance(p: Pixels) -> str:
    """image_id and the distance of its hash to the next image's."""
    nearby = f"(SELECT a.image_id, a.hash AS h, b.hash AS k FROM ({phash(p)}) a JOIN ({phash(p)}) b ON b.image_id = a.image_id + 1)"
    return f"SELECT image_id, CAST(bit_count({p.xor('h', 'k')}) AS BIGINT) AS distance FROM {nearby} n"


def palette(pixels: DataFrame, count: int, rounds: int = 12, most: int = 32_768) -> DataFrame:
    """image_id, rank, r, g, b, a, members: k-means colours, largest cluster first.

    Seeds are spread along the pixel order, so runs agree.  One image is one group: the algorithm is sequential in rounds
    and reads at most ``most`` strided samples, so a group's memory is bounded by one image.
    """
    check(1 <= count <= 256, "count")
    schema = "image_id long, rank int, r int, g int, b int, a int, members long"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        data = image_array(table, CHANNELS)[0].astype(np.float32)
        samples = data[:: max(1, len(data) // most)]
        k = min(count, len(samples))
        center = samples[[len(samples) * i // k for i in range(k)]].copy()
        members = np.zeros(k, np.int64)
        for _ in range(rounds):
            best = ((samples[:, None] - center[None]) ** 2).sum(2).argmin(1)
            members = np.bincount(best, minlength=k)
            for i in np.flatnonzero(members):
                center[i] = samples[best == i].mean(0)
        order = np.argsort(-members, kind="stable")
        colors = np.clip(np.floor(center[order] + 0.5), 0, 255).astype(np.int32)
        columns = {"image_id": pa.array([key[0].as_py()] * k, pa.int64()), "rank": pa.array(range(k), pa.int32()), **{c: pa.array(colors[:, i]) for i, c in enumerate(CHANNELS)}}
        return pa.table({**columns, "members": pa.array(members[order].astype(np.int64))})

    return pixels.groupBy("image_id").applyInArrow(run, schema)


def dominant_color(pixels: DataFrame) -> DataFrame:
    return palette(pixels, 5).where(F.col("rank") == 0).drop("rank", "members")


def remove_background(pixels: DataFrame, width: int, height: int, tolerance: int) -> DataFrame:
    """Clear what a 4-connected fill from the corners of the first pixel's colour reaches; feather its boundary.

    A fill is a fixpoint with as many rounds as the longest path, so each image is filled as one group of its pixels.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        data = image_array(table, CHANNELS)[0].astype(np.int64).reshape(height, width, 4)
        far = np.abs(data - data[0, 0]).max(2)
        near = far <= tolerance
        reach = np.zeros_like(near)
        for y, x in ((0, 0), (0, width - 1), (height - 1, 0), (height - 1, width - 1)):
            reach[y, x] = near[y, x]
        while True:
            grown = reach.copy()
            grown[1:] |= reach[:-1]
            grown[:-1] |= reach[1:]
            grown[:, 1:] |= reach[:, :-1]
            grown[:, :-1] |= reach[:, 1:]
            grown &= near
            if (grown == reach).all():
                break
            reach = grown
        beside = np.zeros_like(reach)
        beside[1:] |= reach[:-1]
        beside[:-1] |= reach[1:]
        beside[:, 1:] |= reach[:, :-1]
        beside[:, :-1] |= reach[:, 1:]
        colors = np.abs(data[..., :3] - data[0, 0, :3]).max(2)  # alpha counts for the fill, not for the feather
        soft = beside & ~reach & (colors < 2 * (tolerance + 1))
        alpha = data[..., 3].copy()
        alpha[soft] = alpha[soft] * colors[soft] // (2 * (tolerance + 1))
        alpha[reach] = 0
        y, x = np.divmod(np.arange(height * width), width)
        named = {"image_id": np.full(height * width, key[0].as_py(), np.int64), "y": y, "x": x, **{c: np.ascontiguousarray(data[..., i]).ravel() for i, c in enumerate("rgb")}, "a": alpha.ravel()}
        return pa.table({k: pa.array(v) for k, v in named.items()})

    return pixels.groupBy("image_id").applyInArrow(run, "image_id long, y long, x long, r long, g long, b long, a long")
