"""Display lists, profiles, detection and whole transforms."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.errors import CorruptError, PlanError, RangeError, UnsupportedVariantError
from pixelmill.functions import icc
from pixelmill.operators import detect
from pixelmill.operators.display import DisplayList
from pixelmill.plans import transform
from pixelmill.sources import codecs, images


def test_display_list_is_culled_before_drawing():
    d = DisplayList().rect(100, 100, 5, 5, (1, 1, 1, 255)).ellipse(4, 4, 1, 1, (2, 2, 2, 255)).rect(0, 0, 8, 8, (3, 3, 3, 255)).rect(1, 1, 2, 2, (4, 4, 4, 255))
    assert [s.color[0] for s in d.visible(8, 8)] == [3, 4] and (d.culled, d.covered) == (1, 1)
    assert d.bounds() == (0, 0, 105, 105)
    half = DisplayList().ellipse(4, 4, 1, 1, (2, 2, 2, 255)).rect(0, 0, 8, 8, (3, 3, 3, 128))
    assert len(half.visible(8, 8)) == 2


def test_display_stack():
    d = DisplayList().save().translate(2, 3).scale(2, 2).rect(0, 0, 1, 1, (0, 0, 0, 255)).restore()
    assert d.shapes[0].bounds() == (2, 3, 4, 5) and d.transform == (1, 0, 0, 1, 0, 0)
    with pytest.raises(PlanError):
        d.restore()


def profile(curve=b"curv" + bytes(4) + struct.pack(">IH", 1, 563)):
    tags = {k: b"XYZ " + bytes(4) + struct.pack(">3i", *(round(row[i] * 65536) for row in icc.SPACES["adobe-rgb"])) for i, k in enumerate((b"rXYZ", b"gXYZ", b"bXYZ"))}
    tags |= dict.fromkeys((b"rTRC", b"gTRC", b"bTRC"), curve)
    head, body, at = b"", b"", 132 + 12 * len(tags)
    for k, v in tags.items():
        head += struct.pack(">4sII", k, at, len(v))
        body, at = body + v, at + len(v)
    return bytes(36) + b"acsp" + bytes(88) + struct.pack(">I", len(tags)) + head + body


def test_icc_parse():
    got, known = icc.parse(profile()), icc.builtin("adobe-rgb")
    assert np.allclose(got.to_xyz, known.to_xyz, atol=1e-4) and np.allclose(got.curves, known.curves, atol=1e-6)
    assert np.allclose(icc.matrix_between(icc.builtin(), icc.builtin()), np.eye(3))
    with pytest.raises(CorruptError):
        icc.parse(b"no")
    with pytest.raises(UnsupportedVariantError):
        icc.parse(profile(b"mft2" + bytes(20)))


def toy_cascade():
    # a bright middle block: no neighbour reaches it, so the pattern is 0
    return detect.Cascade((9, 9), ((1.0, (detect.Weak((0, 0, 3, 3), frozenset({0}), (1.0, -1.0)),)),))


def test_detection_finds_a_spot(spark):
    gray = np.full((40, 50, 1), 20, np.uint8)
    gray[12:24, 20:32] = 220
    rows = [(1, 50, 40, 1, "png", gray.tobytes(), None), (2, 50, 40, 1, "png", bytes(2000), None)]
    dense = spark.createDataFrame(rows, images.DENSE)
    boxes = detect.detect(dense, toy_cascade(), neighbors=2).collect()
    assert boxes and {b.image_id for b in boxes} == {1}
    best = boxes[0]
    assert abs(best.x + best.width / 2 - 26) < 5 and abs(best.y + best.height / 2 - 18) < 5
    f = detect.focus(spark.createDataFrame(boxes), 50, 40).first()
    assert abs(f.fx - 0.52) < 0.1 and abs(f.fy - 0.45) < 0.1
    with pytest.raises(RangeError):
        detect.Cascade((9, 9), ((0.0, (detect.Weak((3, 0, 3, 3), frozenset({1}), (0, 0)),)),)).check()


def test_transform_passes_through_or_works(spark):
    image = np.random.default_rng(2).integers(0, 256, (6, 8, 3)).astype(np.uint8)
    rows = [(1, codecs.encode(image, "png")), (2, codecs.encode(image, "bmp"))]
    files = spark.createDataFrame(rows, "image_id long, content binary")
    same = {r.image_id: bytes(r.content) for r in transform.transform(files, 8, 6, brightness=1.0).collect()}
    assert same[1] == rows[0][1] and (codecs.decode(same[2])[..., :3] == image).all()
    done = transform.transform(files, 8, 6, to="tiff", crop=(1, 1, 4, 4), rotate=90, invert=True).collect()
    want = 255 - np.rot90(image[1:5, 1:5], -1)
    for r in done:
        assert r.format == "tiff" and (codecs.decode(bytes(r.content))[..., :3] == want).all()
    with pytest.raises(RangeError):
        transform.planned(8, 8, sparkle=1)


def test_work_counters(spark):
    df = spark.createDataFrame([(1, 0, i, 0, 0, 0, a) for i, a in enumerate((255, 0, 7))], "image_id long, y long, x long, r long, g long, b long, a long")
    counted, seen = transform.work(df)
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"pixels": 3, "not_opaque": 2, "partial": 1}


def test_artifact_key(spark):
    row = spark.createDataFrame([(b"abc",)], "content binary").select(images.artifact_key("o/", F.col("content"), {"w": 1, "b": 2}).alias("k")).first()
    assert row.k == "o/ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad?b=2&w=1"
