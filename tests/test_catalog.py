"""Registered queries in both engines on the smallest tables; all of them with CATALOG=all, else one of each family."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
FAMILIES = [
    "flagship", "to_gray", "hue", "preset_chrome", "dither", "noise", "hsv_rgb", "multigradient_rgb_sized", "crop_polygon", "trim", "resize_catmull_16", "fit_pad", "gravity_se", "gaussian_blur", "median", "halftone",
    "auto_levels", "rotate_free", "phash_distance", "integral_image", "polygon_nonzero", "blend_soft_light", "display_render", "draw_text_styled", "png_roundtrip", "hist_sliding", "select_max_quality", "encode_cost",
]
NAMES = sorted(set(entry.oracle_sql()) & set(entry.queries())) if os.environ.get("CATALOG") == "all" else FAMILIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_both_engines_agree(spark, duck, name):
    got = entry.queries()[name](spark, TABLES)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert rows == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str) and rows


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry.__doc__


def test_entry(spark):
    assert entry.entry(spark).columns == ["image_id", "l", "n"]
