"""A relation of pixels as a query text in Spark's or DuckDB's dialect.

Operators are functions from a :class:`Pixels` to a :class:`Pixels`.  They write queries in a common subset of SQL and ask
the relation for the few forms in which the dialects differ.  Spark plans the text like any DataFrame expression, so
nested projections collapse, filters move down and windows share sorts; the second dialect gives every operator an
independent engine to be compared with.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

CHANNELS = ("r", "g", "b", "a")
COLORS = ("r", "g", "b")


def num(x: float) -> str:
    """A literal of type double in both dialects."""
    return f"({float(x)!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})"


def clamp(e: str) -> str:
    return f"least(greatest({e}, 0), 255)"


@dataclass(frozen=True)
class Pixels:
    """A query with the columns image_id, y, x, r, g, b, a; every image has the same extent."""

    sql: str
    width: int
    height: int
    dialect: str = "spark"
    channels: int = 4
    dealt: bool = False

    # forms that differ between the dialects

    @property
    def spark(self) -> bool:
        return self.dialect == "spark"

    def div(self, a: str, b: str) -> str:
        """Integer division, truncating toward zero."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def big(self, e: str) -> str:
        return f"CAST({e} AS BIGINT)"

    def floor(self, e: str) -> str:
        """Floor of a double as an integer."""
        return f"CAST(floor({e}) AS BIGINT)"

    def round8(self, e: str) -> str:
        """A double rounded half up and clamped to a sample."""
        return clamp(self.floor(f"({e}) + 0.5e0"))

    def lookup(self, table: Sequence[int], e: str) -> str:
        """table[e] for a table of numbers."""
        body = ",".join(map(str, table))
        return f"CAST(element_at(array({body}), CAST(({e}) + 1 AS INT)) AS BIGINT)" if self.spark else f"CAST(([{body}])[({e}) + 1] AS BIGINT)"

    def values(self, columns: Sequence[str], rows: Iterable[Sequence[object]], name: str) -> str:
        """An inline table for a FROM clause."""
        body = ",".join("(" + ",".join(num(v) if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)
        return f"(SELECT * FROM (VALUES {body}) AS {name}_({','.join(columns)})) AS {name}"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def shr(self, a: str, n: int | str) -> str:
        return f"shiftright({a}, CAST({n} AS INT))" if self.spark else f"(({a}) >> ({n}))"

    def series(self, n: int, name: str, column: str = "i") -> str:
        """Rows 0 to n - 1."""
        return f"(SELECT id AS {column} FROM range({n})) AS {name}" if self.spark else f"(SELECT range AS {column} FROM range({n})) AS {name}"

    def by_image(self) -> Pixels:
        """The same rows dealt by image, once: windows over an image's rows and columns then need no exchange of their own."""
        if self.dealt or not self.spark:
            return self
        return replace(self, sql=f"SELECT * FROM ({self.sql}) t DISTRIBUTE BY image_id", dealt=True)

    # building queries

    def select(self, r: str | None = None, g: str | None = None, b: str | None = None, a: str | None = None, y: str = "y", x: str = "x", where: str = "", **more) -> Pixels:
        """A projection of this relation; what is not named stays."""
        body = ", ".join([f"{y} AS y" if y != "y" else "y", f"{x} AS x" if x != "x" else "x", *(f"{v} AS {c}" if v is not None else c for c, v in zip(CHANNELS, (r, g, b, a), strict=True))])
        return replace(self, sql=f"SELECT image_id, {body} FROM ({self.sql}) t{' WHERE ' + where if where else ''}", **more)

    def each(self, form, alpha: bool = False, **more) -> Pixels:
        """Apply ``form`` (name of a channel to an expression) to the colours, and to alpha if wanted."""
        done = {c: form(c) for c in (CHANNELS if alpha else COLORS)}
        return self.select(**done, **more)

    def derive(self, columns: str, more: str = "*") -> str:
        return f"(SELECT {more}, {columns} FROM ({self.sql}) t)"

    def of(self, sql: str, **more) -> Pixels:
        return replace(self, sql=sql, **more)


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Rec. 709 luma in 16.16, rounded; non-negative, so a division by 65536 is a shift."""
    return f"((13933 * {r} + 46871 * {g} + 4732 * {b} + 32768) >> 16)"


def fixture_gray(dialect: str) -> str:
    """8 x 8 grey images from the rows of ``embeddings``: image_id, y, x, v."""
    if dialect == "spark":
        return """SELECT CAST(vec_id AS BIGINT) AS image_id, CAST(pos div 8 AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x,
 CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.5e0) * 255.0e0 + 0.5e0))) AS BIGINT) AS v
 FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v"""
    return """SELECT CAST(vec_id AS BIGINT) AS image_id, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x,
 CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 0.5e0) * 255.0e0 + 0.5e0))) AS BIGINT) AS v
 FROM embeddings, range(1, 65) r(i)"""


def fixture(dialect: str) -> Pixels:
    """8 x 8 RGBA images, each from four consecutive rows of ``embeddings``; planes that a last, incomplete image lacks are 255."""
    d = "div" if dialect == "spark" else "//"
    pivot = ", ".join(f"coalesce(CAST(max(CASE WHEN image_id % 4 = {i} THEN v END) AS BIGINT), 255) AS {c}" for i, c in enumerate(CHANNELS))
    sql = f"SELECT image_id {d} 4 AS image_id, y, x, {pivot} FROM ({fixture_gray(dialect)}) f GROUP BY 1, 2, 3"
    return Pixels(sql, 8, 8, dialect)
