"""Plain, slow versions of raster operators in numpy, written from the semantics alone; pictures are h x w x 4 arrays."""

import math

import numpy as np


def half_up(x):
    return np.clip(np.floor(np.asarray(x, float) + 0.5), 0, 255).astype(int)


def over255(v):
    return (v + 127) // 255


def mode_value(mode, s, d):
    if mode == "multiply":
        return over255(s * d)
    if mode == "screen":
        return 255 - over255((255 - s) * (255 - d))
    if mode in ("overlay", "hard_light"):
        low = d if mode == "overlay" else s
        return over255(2 * s * d) if low <= 127 else 255 - over255(2 * (255 - s) * (255 - d))
    if mode == "soft_light":
        cb, cs = d / 255, s / 255
        if cs <= 0.5:
            out = cb - (1 - 2 * cs) * cb * (1 - cb)
        else:
            out = cb + (2 * cs - 1) * ((((16 * cb - 12) * cb + 4) * cb if cb <= 0.25 else math.sqrt(cb)) - cb)
        return int(out * 255 + 0.5)
    return {
        "darken": min(s, d), "lighten": max(s, d), "difference": abs(s - d), "exclusion": s + d - over255(2 * s * d), "add": min(255, s + d), "subtract": max(0, d - s),
    }.get(mode, s)


def blend(dst, src, alpha, mode="normal"):
    """One pixel over another; lists of four."""
    if alpha <= 0:
        return list(dst)
    if mode == "replace":
        return [*src[:3], alpha]
    back = dst[3]
    top = over255(alpha * 255 + back * (255 - alpha))
    out = []
    for s, d in zip(src[:3], dst[:3]):
        up = alpha * (255 - back) * s + alpha * back * mode_value(mode, s, d) + (255 - alpha) * back * d
        out.append(min(255, (up + 255 * top // 2) // (255 * top)))
    return [*out, top]


def draw(pic, points, color, mode="normal"):
    """Blend a colour into points (x, y) one after another."""
    out = pic.copy()
    for x, y in points:
        if 0 <= x < pic.shape[1] and 0 <= y < pic.shape[0]:
            out[y, x] = blend(out[y, x].tolist(), color, color[3], mode)
    return out


def stamp(pic, src, mode, x=0, y=0, opacity=1.0, tile=False):
    out, scale = pic.copy(), int(opacity * 255 + 0.5)
    h, w = pic.shape[:2]
    for j in range(h):
        for i in range(w):
            v, u = j - y, i - x
            if tile:
                v, u = v % src.shape[0], u % src.shape[1]
            if 0 <= v < src.shape[0] and 0 <= u < src.shape[1]:
                px = src[v, u].tolist()
                out[j, i] = blend(out[j, i].tolist(), px, px[3] * scale // 255, mode)
    return out


def line(x1, y1, x2, y2):
    """Steps along the longer way; a step aside where the doubled error passes strictly."""
    dx, dy = abs(x2 - x1), abs(y2 - y1)
    out, err, x, y = [(x1, y1)], dx - dy, x1, y1
    while (x, y) != (x2, y2):
        e = 2 * err
        if e > -dy:
            err, x = err - dy, x + (1 if x2 > x1 else -1)
        if e < dx:
            err, y = err + dx, y + (1 if y2 > y1 else -1)
        out.append((x, y))
    return out


def edge(pic, x, y):
    h, w = pic.shape[:2]
    return pic[min(max(y, 0), h - 1), min(max(x, 0), w - 1)].astype(float)


def bilinear(pic, x, y):
    x0, y0 = math.floor(x), math.floor(y)
    fx, fy = x - x0, y - y0
    top = edge(pic, x0, y0) * (1 - fx) + edge(pic, x0 + 1, y0) * fx
    low = edge(pic, x0, y0 + 1) * (1 - fx) + edge(pic, x0 + 1, y0 + 1) * fx
    return half_up(np.round(top * (1 - fy) + low * fy, 6))


def warped(pic, w, h, back, fill=(0, 0, 0, 0)):
    """``back`` gives the source's place of an output's place, both continuous."""
    out = np.zeros((h, w, 4), int)
    for j in range(h):
        for i in range(w):
            x, y = (round(float(v), 9) for v in back(i + 0.5, j + 0.5))
            out[j, i] = bilinear(pic, x - 0.5, y - 0.5) if 0 <= x < pic.shape[1] and 0 <= y < pic.shape[0] else fill
    return out


def trail(pic, places):
    """The rounded mean of samples at several places of each pixel's index."""
    out = np.zeros_like(pic)
    for j in range(pic.shape[0]):
        for i in range(pic.shape[1]):
            got = [bilinear(pic, round(x, 9), round(y, 9)) for x, y in places(i, j)]
            out[j, i] = (np.sum(got, 0) + len(got) // 2) // len(got)
    return out


def cubic(t):
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def axis(n, count, kind, origin=0.0, extent=None):
    """For each output a dict of sample to 16.16 weight."""
    extent = n if extent is None else extent
    step = extent / count
    scale = max(1.0, step)
    low, high = max(0, math.floor(origin)), min(n, math.ceil(origin + extent)) - 1
    out = []
    for i in range(count):
        mid, reach = origin + (i + 0.5) * step, {"box": 0.5, "bilinear": 1.0, "catmull_rom": 2.0}[kind] * scale
        w = {}
        for j in range(low, high + 1):
            if not mid - reach - 1e-12 <= j + 0.5 <= mid + reach + 1e-12:
                continue
            d = abs(j + 0.5 - mid) / scale
            w[j] = max(0.0, min(mid + reach, j + 1) - max(mid - reach, j)) if kind == "box" else max(0.0, 1 - d) if kind == "bilinear" else cubic(d)
        f = {j: math.trunc(v / sum(w.values()) * 65536 + math.copysign(0.5, v)) for j, v in w.items()}
        f[max(f, key=lambda j: (f[j], -j))] += 65536 - sum(f.values())
        out.append({j: v for j, v in f.items() if v})
    return out


def resized(pic, w, h, kind, window=None):
    ox, oy, ex, ey = window or (0.0, 0.0, pic.shape[1], pic.shape[0])
    out = np.zeros((h, w, 4), int)
    xs, ys = axis(pic.shape[1], w, kind, ox, ex), axis(pic.shape[0], h, kind, oy, ey)
    for j in range(h):
        for i in range(w):
            if len(xs[i]) == len(ys[j]) == 1:
                out[j, i] = pic[next(iter(ys[j])), next(iter(xs[i]))]
                continue
            total = [0] * 4
            for y, wy in ys[j].items():
                for x, wx in xs[i].items():
                    *rgb, a = pic[y, x].tolist()
                    for c, v in enumerate([*(v * a // 255 for v in rgb), a]):
                        total[c] += v * wx * wy
            got = [min(255, max(0, (t + (1 << 31)) >> 32)) for t in total]
            if 0 < got[3] < 255:
                got[:3] = [min(255, (v * 255 + got[3] // 2) // got[3]) for v in got[:3]]
            out[j, i] = got
    return out
