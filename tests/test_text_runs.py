"""Runs of mixed fonts, and orientations of boxed files."""

import pytest

from pixelmill.errors import RangeError
from pixelmill.operators import text
from pixelmill.relation import Pixels
from pixelmill.sources import isobmff

SMALL = text.FontSet(text.Font(2, 1, {ord(c): text.Glyph(2, 0, 2, ["10", "11"]) for c in "ab "}))
LARGE = text.FontSet(text.Font(5, 2, {ord(c): text.Glyph(4, 0, 5, ["1110"] * 5) for c in "AB"}))


def test_measure_runs():
    got = text.measure_runs([text.Run(SMALL, "ab "), text.Run(LARGE, "AB"), text.Run(SMALL, "a?")])
    assert got == {"width": 6 + 8 + 2 + 1, "height": 7, "lines": 1, "ascent": 5, "line_height": 7, "glyphs": 7, "missing": 1}
    # the word that two runs make goes to the next line as a whole
    got = text.measure_runs([text.Run(SMALL, "ab a"), text.Run(LARGE, "A")], 9)
    assert (got["lines"], got["width"], got["height"], got["ascent"], got["line_height"]) == (2, 6, 3 + 7, 2, 3)
    assert text.measure_runs([text.Run(SMALL, "a\n\nb")])["lines"] == 3
    assert text.measure_runs([text.Run(SMALL, "ababab")], 5)["lines"] == 3
    with pytest.raises(RangeError):
        text.measure_runs([])
    with pytest.raises(RangeError):
        text.measure_runs([text.Run(SMALL, "a")] * 17)


def test_draw_runs_on_one_baseline(spark):
    spark.range(0, 8).selectExpr("1L AS image_id", "id AS y").crossJoin(spark.range(0, 10).withColumnRenamed("id", "x")).selectExpr("*", "0L AS r", "0L AS g", "0L AS b", "255L AS a").createOrReplaceTempView("dark")
    runs = [text.Run(SMALL, "a", (255, 0, 0, 255)), text.Run(LARGE, "A", None, None, (1, 0, 0, (0, 0, 255, 255)))]
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in spark.sql(text.draw_runs(Pixels("SELECT * FROM dark", 10, 8), runs, 0, 1, (0, 255, 0, 255)).sql).collect()}
    lit = {k: v for k, v in got.items() if any(v)}
    red, green = {(4, 0), (5, 0), (5, 1)}, {(y, x) for y in range(1, 6) for x in (2, 3, 4)}
    assert {k for k, v in lit.items() if v == (255, 0, 0)} == red and {k for k, v in lit.items() if v == (0, 255, 0)} == green
    assert {k for k, v in lit.items() if v == (0, 0, 255)} == {(y, 5) for y in range(1, 6)}


def box(kind, body):
    return (8 + len(body)).to_bytes(4, "big") + kind + body


@pytest.mark.parametrize(("turn", "mirror", "want"), [(0, None, 0), (1, None, 8), (2, None, 3), (3, None, 6), (0, 0, 4), (0, 1, 2), (1, 0, 5), (3, 1, 5)])
def test_orientation_of_the_primary_item(turn, mirror, want):
    listed = box(b"ispe", bytes(12)) + box(b"irot", bytes((turn,))) + (box(b"imir", bytes((mirror,))) if mirror is not None else b"") + box(b"irot", b"\x02")
    own = bytes((0x81, 2, 3)) if mirror is not None else bytes((0x81, 2))
    linked = bytes(4) + (2).to_bytes(4, "big") + b"\0\x07" + bytes((1, 4)) + b"\0\x01" + bytes((len(own),)) + own
    meta = box(b"meta", bytes(4) + box(b"pitm", bytes(4) + b"\0\x01") + box(b"iprp", box(b"ipco", listed) + box(b"ipma", linked)))
    assert isobmff.orientation(box(b"ftyp", b"avif" + bytes(4)) + meta) == want
    assert isobmff.orientation(meta[:-1]) == 0 and isobmff.orientation(b"") == 0
