"""Object detection by a cascade of local binary patterns on integral images, one image at a time in Arrow batches.

A cascade is data: a window size and stages, each a threshold and weak classifiers (a rectangle of 3 x 3 equal blocks, a
set of 256 bits of patterns, and two leaf values).  None ships with the library; callers pass a trained one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.errors import RangeError
from pixelmill.operators import stencil
from pixelmill.relation import Pixels

BOXES = "image_id long, x int, y int, width int, height int, neighbors int"


@dataclass(frozen=True)
class Weak:
    rect: tuple[int, int, int, int]  # x, y, width and height of one block
    patterns: frozenset[int]  # codes that give the first leaf
    leaves: tuple[float, float]


@dataclass(frozen=True)
class Cascade:
    window: tuple[int, int]
    stages: tuple[tuple[float, tuple[Weak, ...]], ...]

    def check(self) -> None:
        for _, weak in self.stages:
            for w in weak:
                x, y, bw, bh = w.rect
                if min(x, y) < 0 or min(bw, bh) < 1 or x + 3 * bw > self.window[0] or y + 3 * bh > self.window[1] or any(not 0 <= c < 256 for c in w.patterns):
                    raise RangeError("a classifier leaves its window")


def integral(gray: np.ndarray) -> np.ndarray:
    out = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1), np.int64)
    out[1:, 1:] = gray.cumsum(0).cumsum(1)
    return out


def codes(sums: np.ndarray, xs: np.ndarray, ys: np.ndarray, rect: tuple[int, int, int, int]) -> np.ndarray:
    """The 8-bit pattern of 3 x 3 blocks at many places: clockwise from the top left, the first the highest bit."""
    x0, y0, w, h = rect
    block = {}
    for j in range(3):
        for i in range(3):
            x, y = xs + x0 + i * w, ys + y0 + j * h
            block[i, j] = sums[y + h, x + w] - sums[y, x + w] - sums[y + h, x] + sums[y, x]
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    return sum((block[p] >= block[1, 1]).astype(np.int64) << (7 - k) for k, p in enumerate(ring))


def _reduced(gray: np.ndarray, factor: float) -> np.ndarray:
    h, w = max(1, int(gray.shape[0] / factor)), max(1, int(gray.shape[1] / factor))
    ys, xs = (np.arange(h) + 0.5) * gray.shape[0] / h - 0.5, (np.arange(w) + 0.5) * gray.shape[1] / w - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, gray.shape[0] - 1), np.clip(np.floor(xs).astype(int), 0, gray.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, gray.shape[0] - 1), np.minimum(x0 + 1, gray.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    top = gray[y0][:, x0] * (1 - fx) + gray[y0][:, x1] * fx
    low = gray[y1][:, x0] * (1 - fx) + gray[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.int64)


def search(gray: np.ndarray, cascade: Cascade, scale: float = 1.1, neighbors: int = 3, min_size: int = 0, max_size: int = 0, most: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Boxes x, y, width, height, neighbours: a pyramid of reductions, steps of two below factor two, grouped by likeness."""
    raw, factor = [], 1.0
    ww, wh = cascade.window
    while gray.shape[0] / factor >= wh and gray.shape[1] / factor >= ww:
        size = int(ww * factor + 0.5)
        if size >= min_size and (not max_size or size <= max_size):
            level = _reduced(gray, factor) if factor > 1 else gray
            sums, step = integral(level), 1 if factor >= 2 else 2
            ys, xs = (a.ravel() for a in np.mgrid[0 : level.shape[0] - wh + 1 : step, 0 : level.shape[1] - ww + 1 : step])
            for threshold, weak in cascade.stages:
                if not len(xs):
                    break
                total = np.zeros(len(xs))
                for w in weak:
                    total += np.where(np.isin(codes(sums, xs, ys, w.rect), list(w.patterns)), *w.leaves)
                keep = total >= threshold - 1e-5
                xs, ys = xs[keep], ys[keep]
            raw += [(int(x * factor + 0.5), int(y * factor + 0.5), size, int(wh * factor + 0.5)) for x, y in zip(xs, ys, strict=True)]
        factor *= scale
    return group(raw[:most], neighbors)


def group(boxes: list[tuple[int, int, int, int]], neighbors: int, eps: float = 0.2) -> list[tuple[int, int, int, int, int]]:
    """Means of classes of like boxes with enough members, the most numerous first; a box inside a stronger one goes."""
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(boxes):
        for j in range(i):
            b = boxes[j]
            d = eps * (min(a[2], b[2]) + min(a[3], b[3])) / 2
            if max(abs(a[0] - b[0]), abs(a[1] - b[1]), abs(a[0] + a[2] - b[0] - b[2]), abs(a[1] + a[3] - b[1] - b[3])) <= d:
                root[find(i)] = find(j)
    classes: dict[int, list] = {}
    for i, b in enumerate(boxes):
        classes.setdefault(find(i), []).append(b)
    means = [(*(int(sum(c) / len(g) + 0.5) for c in zip(*g, strict=True)), len(g)) for g in classes.values() if len(g) >= max(1, neighbors)]
    kept = [m for m in means if not any(o is not m and o[4] > max(3, m[4]) and o[0] <= m[0] and o[1] <= m[1] and o[0] + o[2] >= m[0] + m[2] and o[1] + o[3] >= m[1] + m[3] for o in means)]
    return sorted(kept, key=lambda m: (-m[4], m[:4]))


def detect(dense: DataFrame, cascade: Cascade, **how) -> DataFrame:
    """Boxes of dense rows; luma is (77 r + 150 g + 29 b) >> 8."""
    cascade.check()

    def run(batches):
        for batch in batches:
            rows = []
            for image_id, w, h, c, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                flat = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.int64)
                gray = flat[..., 0] if c < 3 else (77 * flat[..., 0] + 150 * flat[..., 1] + 29 * flat[..., 2]) >> 8
                rows += [(image_id, *box) for box in search(gray, cascade, **how)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *[pa.int32()] * 5], strict=True)], names=[c.split()[0] for c in BOXES.split(", ")])

    return dense.where("data is not null").select("image_id", "width", "height", "channels", "data").mapInArrow(run, BOXES)


def focus(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, fx, fy: the mean middle of its boxes, by neighbours; images without a box have no row."""
    w = F.sum("neighbors")
    return boxes.groupBy("image_id").agg((F.sum(F.col("neighbors") * (F.col("x") + F.col("width") / 2)) / w / width).alias("fx"), (F.sum(F.col("neighbors") * (F.col("y") + F.col("height") / 2)) / w / height).alias("fy"))


def blur_boxes(p: Pixels, boxes: str, sigma: float) -> Pixels:
    """Blur the pixels that a box of the same image holds; ``boxes`` is a query of image_id, x, y, width, height."""
    inside = f"(SELECT t.*, EXISTS (SELECT 1 FROM ({boxes}) b WHERE b.image_id = t.image_id AND t.x >= b.x AND t.x < b.x + b.width AND t.y >= b.y AND t.y < b.y + b.height) AS hit FROM ({p.sql}) t)"
    blurred = stencil.gaussian_blur(p, sigma)
    body = ", ".join(f"CASE WHEN u.hit THEN o.{c} ELSE u.{c} END AS {c}" for c in "rgba")
    return p.of(f"SELECT u.image_id, u.y, u.x, {body} FROM {inside} u JOIN ({blurred.sql}) o ON o.image_id = u.image_id AND o.y = u.y AND o.x = u.x")


def pixelate_boxes(p: Pixels, boxes: str, size: int) -> Pixels:
    """Block means inside each box of the same image, blocks counted from the box's corner; ``boxes`` as for a blur.

    A pixel in several boxes takes the means of the one that begins last, by rows and then columns.
    """
    if size < 2:
        return p
    inside = "b.image_id = t.image_id AND t.x >= b.x AND t.x < b.x + b.width AND t.y >= b.y AND t.y < b.y + b.height"
    cells = f"(SELECT t.*, b.x AS bx, b.y AS by_, {p.div('t.y - b.y', str(size))} AS cy, {p.div('t.x - b.x', str(size))} AS cx FROM ({p.sql}) t JOIN ({boxes}) b ON {inside})"
    means = ", ".join(f"{p.div(f'CAST(sum({c}) AS BIGINT) + {p.div("count(*)", "2")}', 'count(*)')} AS m_{c}" for c in "rgba")
    blocks = f"(SELECT image_id, bx, by_, cy, cx, {means} FROM {cells} q GROUP BY image_id, bx, by_, cy, cx)"
    ranked = f"(SELECT q.image_id, q.y, q.x, m.m_r, m.m_g, m.m_b, m.m_a, row_number() OVER (PARTITION BY q.image_id, q.y, q.x ORDER BY q.by_ DESC, q.bx DESC) AS k FROM {cells} q JOIN {blocks} m ON m.image_id = q.image_id AND m.bx = q.bx AND m.by_ = q.by_ AND m.cy = q.cy AND m.cx = q.cx)"
    body = ", ".join(f"coalesce(n.m_{c}, t.{c}) AS {c}" for c in "rgba")
    return p.of(f"SELECT t.image_id, t.y, t.x, {body} FROM ({p.sql}) t LEFT JOIN (SELECT * FROM {ranked} z WHERE k = 1) n ON n.image_id = t.image_id AND n.y = t.y AND n.x = t.x")


def focused_fit(pixels: DataFrame, extent: tuple[int, int], target: tuple[int, int], mode: str, where: DataFrame) -> DataFrame:
    """Fit images to a target around a focus (image_id, fx, fy) of their own: the middle of faces, or of detail.

    Images without a focus keep their middle.  The crop's place is a column that is joined by image and filters pixels.
    """
    from pixelmill.operators import geometry, resample

    w, h = extent
    how = resample.fit_geometry(w, h, *target, mode)
    scaled = Pixels("SELECT image_id, y, x, r, g, b, a FROM {pixels}", w, h)
    if how["scale"] != (w, h):
        scaled = resample.resize(scaled, *how["scale"])
    session = pixels.sparkSession
    if not how["crop"]:
        out = geometry.place(scaled, *how["canvas"][:2], *how["canvas"][2:], (0, 0, 0, 0)) if how["canvas"] else scaled
        return session.sql(out.sql, pixels=pixels)
    (sw, sh), (_, _, cw, ch) = how["scale"], how["crop"]
    place = lambda f, n, c: F.least(F.lit(n - c), F.greatest(F.lit(0), F.floor(f * n - c / 2 + 0.5))).cast("int")
    spots = pixels.select("image_id").distinct().join(where.select("image_id", place(F.col("fx"), sw, cw).alias("_l"), place(F.col("fy"), sh, ch).alias("_t")), "image_id", "left")
    middle = how["crop"][:2]
    spots = spots.select("image_id", F.coalesce("_l", F.lit(middle[0])).alias("_l"), F.coalesce("_t", F.lit(middle[1])).alias("_t"))
    rows = session.sql(scaled.sql, pixels=pixels).join(spots, "image_id")
    kept = rows.where((F.col("x") >= F.col("_l")) & (F.col("x") < F.col("_l") + cw) & (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_t") + ch))
    return kept.select("image_id", (F.col("y") - F.col("_t")).alias("y"), (F.col("x") - F.col("_l")).alias("x"), "r", "g", "b", "a")
