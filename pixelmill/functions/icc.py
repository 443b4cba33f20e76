"""ICC profiles of the matrix and curve kind: parsing on the driver, conversion as tables and a matrix in one projection."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pixelmill.errors import CorruptError, UnsupportedVariantError
from pixelmill.relation import COLORS, Pixels, num

# D50-adapted primaries of four well-known spaces, rows X, Y, Z.
SPACES = {
    "srgb": ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733)),
    "display-p3": ((0.5151187, 0.2919778, 0.1571035), (0.2411892, 0.6922441, 0.0665668), (-0.0010505, 0.0418791, 0.7840713)),
    "adobe-rgb": ((0.6097559, 0.2052401, 0.1492240), (0.3111242, 0.6256560, 0.0632197), (0.0194811, 0.0608902, 0.7448387)),
    "rec2020": ((0.6734241, 0.1656411, 0.1251286), (0.2790177, 0.6753402, 0.0456377), (-0.0019300, 0.0299784, 0.7973330)),
}


@dataclass(frozen=True)
class Profile:
    to_xyz: tuple[tuple[float, ...], ...]
    curves: tuple[tuple[float, ...], ...]  # three tables of 256 linear values


def srgb_linear(v: float) -> float:
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def srgb_encoded(v: float) -> float:
    v = min(1.0, max(0.0, v))
    return 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055


def builtin(name: str = "srgb") -> Profile:
    gamma = {"adobe-rgb": 563 / 256}.get(name)
    table = tuple((i / 255) ** gamma if gamma else srgb_linear(i / 255) for i in range(256))
    return Profile(SPACES[name], (table, table, table))


def _curve(data: bytes) -> tuple[float, ...]:
    if data[:4] == b"curv":
        n = struct.unpack_from(">I", data, 8)[0]
        if n == 0:
            return tuple(i / 255 for i in range(256))
        points = struct.unpack_from(f">{n}H", data, 12)
        if n == 1:
            return tuple((i / 255) ** (points[0] / 256) for i in range(256))
        out = []
        for i in range(256):
            at = i / 255 * (n - 1)
            j = min(int(at), n - 2)
            out.append((points[j] + (points[j + 1] - points[j]) * (at - j)) / 65535)
        return tuple(out)
    if data[:4] == b"para":
        kind = struct.unpack_from(">H", data, 8)[0]
        p = [v / 65536 for v in struct.unpack_from(f">{(1, 3, 4, 5, 7)[kind]}i", data, 12)]
        g, a, b, c, d, e, f = (p + [0.0] * 7)[:7]
        if kind == 0:
            return tuple((i / 255) ** g for i in range(256))
        if kind in (1, 2):
            low = -b / a
            return tuple(((a * i / 255 + b) ** g if i / 255 >= low else 0.0) + (c if kind == 2 else 0.0) for i in range(256))
        return tuple((a * i / 255 + b) ** g + e if i / 255 >= d else c * i / 255 + f for i in range(256))
    raise UnsupportedVariantError("curve")


def parse(data: bytes) -> Profile:
    if len(data) < 132 or data[36:40] != b"acsp":
        raise CorruptError("no profile")
    tags = {}
    for i in range(struct.unpack_from(">I", data, 128)[0]):
        name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * i)
        tags[name] = data[at : at + size]
    if b"A2B0" in tags or b"A2B1" in tags:
        raise UnsupportedVariantError("a profile of tables")
    try:
        columns = [[v / 65536 for v in struct.unpack_from(">3i", tags[k], 8)] for k in (b"rXYZ", b"gXYZ", b"bXYZ")]
        curves = tuple(_curve(tags[k]) for k in (b"rTRC", b"gTRC", b"bTRC"))
    except (KeyError, struct.error) as e:
        raise CorruptError(str(e)) from None
    return Profile(tuple(zip(*columns, strict=True)), curves)


def inverse3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(v / det for v in r) for r in rows)


def matrix_between(source: Profile, target: Profile):
    """inverse(target) times source."""
    inv = inverse3(target.to_xyz)
    return tuple(tuple(sum(inv[r][k] * source.to_xyz[k][c] for k in range(3)) for c in range(3)) for r in range(3))


def to_srgb(p: Pixels, profile: Profile) -> Pixels:
    """Curves by tables in 1/65535, a matrix, and sRGB's encoding by a table of 4096 steps made of its formula."""
    m = matrix_between(profile, builtin())
    linear = p.derive(", ".join(f"{p.lookup([round(v * 65535) for v in t], c)} AS l{i}" for i, (c, t) in enumerate(zip(COLORS, profile.curves, strict=True))))
    value = lambda r: f"least(1e0, greatest(0e0, round(({' + '.join(f'{num(m[r][k])} * l{k}' for k in range(3))}) / 65535e0, 9)))"
    encode = lambda v: f"CASE WHEN {v} <= 0.0031308e0 THEN 12.92e0 * {v} ELSE 1.055e0 * pow({v}, {num(1 / 2.4)}) - 0.055e0 END"
    body = ", ".join(f"{p.round8(f'round(255e0 * ({encode(value(r))}), 6)')} AS {c}" for r, c in enumerate(COLORS))
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {linear} u")
