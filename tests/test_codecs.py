"""Codecs by round trip and by damage, streams by a file source, text by worked layout."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.errors import CorruptError, RasterError, UnknownFormatError, UnsupportedCodecError
from pixelmill.operators import text
from pixelmill.sources import codecs, images, jpeg
from pixelmill.streaming import windows


def picture(channels, w=37, h=23, seed=0):
    smooth = (np.add.outer(np.arange(h) * 5, np.arange(w) * 3)[..., None] + np.arange(channels) * 40) % 256
    noise = np.random.default_rng(seed).integers(0, 20, (h, w, channels))
    return ((smooth + noise) % 256).astype(np.uint8)


@pytest.mark.parametrize("kind", ["png", "tiff"])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_lossless_round_trip(kind, channels):
    image = picture(channels)
    data = codecs.encode(image, kind)
    assert (codecs.decode(data) == image).all()
    info = codecs.probe(data)
    assert (info.width, info.height, info.format, info.channels) == (37, 23, kind, channels)


@pytest.mark.parametrize("channels", [3, 4])
def test_bmp_round_trip(channels):
    image = picture(channels)
    assert (codecs.decode(codecs.encode(image, "bmp")) == image).all()
    grey = codecs.decode(codecs.encode(picture(1), "bmp"))
    assert (grey[..., 0] == picture(1)[..., 0]).all()


def test_gif_round_trip_and_quantiser():
    image = (picture(3) // 64 * 64).astype(np.uint8)
    got = codecs.decode(codecs.encode(image, "gif"))
    assert (got[..., :3] == image).all() and (got[..., 3] == 255).all()
    with pytest.raises(RasterError):
        codecs.encode(picture(3, 60, 60), "gif")
    few = codecs.median_cut(picture(3, 60, 60), 32)
    assert len(np.unique(few.reshape(-1, 3), axis=0)) <= 32
    assert (codecs.decode(codecs.encode(few, "gif"))[..., :3] == few).all()


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw(bits):
    data = np.random.default_rng(bits).integers(0, 1 << bits, 20_000).astype(np.uint8).tobytes() + bytes(9000)
    assert codecs.lzw_expand(codecs.lzw_compress(data, bits), bits, False) == data


def test_pack_bits():
    assert codecs.unpack_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa") == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")


def test_damage_raises_typed_errors():
    data = codecs.encode(picture(3), "png")
    for cut in (4, 20, 40, len(data) // 2):
        with pytest.raises(RasterError):
            codecs.decode(data[:cut])
    with pytest.raises(UnknownFormatError):
        codecs.decode(b"not an image at all")
    with pytest.raises(UnsupportedCodecError):
        codecs.decode(b"RIFF\0\0\0\0WEBPVP8 " + bytes(40))
    with pytest.raises(CorruptError):
        codecs.probe(b"\x89PNG\r\n\x1a\n")


def test_sniff():
    assert codecs.sniff(b"\0\0\0\x1cftypmif1\0\0\0\0mif1avif") == "avif"
    assert codecs.sniff(b"\0\0\0\x18ftypheic\0\0\0\0mif1heic") == "heif"
    assert codecs.sniff(b"RIFF\0\0\0\0WEBPVP8 ") == "webp"
    assert codecs.sniff(b"") == "unknown"


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b.astype(float)) ** 2).mean()))


@pytest.mark.parametrize(("channels", "quality", "floor"), [(1, 90, 40), (3, 95, 40), (3, 80, 32), (3, 30, 26)])
def test_jpeg_round_trip(channels, quality, floor):
    y, x = np.mgrid[0:43, 0:61]
    image = np.dstack([(128 + 100 * np.sin(x / 9 + c) * np.cos(y / 7)).astype(np.uint8) for c in range(channels)])
    data = jpeg.encode(image, quality)
    got = codecs.decode(data)
    assert got.shape == image.shape and psnr(got, image) > floor
    info = codecs.probe(data)
    assert (info.width, info.height, info.format, info.progressive) == (61, 43, "jpeg", False)
    for cut in (30, len(data) // 2):
        with pytest.raises(RasterError):
            codecs.decode(data[:cut])


def test_jpeg_agrees_with_the_jvms_decoder(spark, tmp_path):
    y, x = np.mgrid[0:24, 0:40]
    image = np.dstack([(128 + 90 * np.sin(x / 9 + c) * np.cos(y / 7)).astype(np.uint8) for c in range(3)])
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(image, 92))
    row = images.read_image_source(spark, str(tmp_path)).first()
    theirs = np.frombuffer(bytes(row.data), np.uint8).reshape(24, 40, 3)
    assert np.abs(theirs.astype(int) - codecs.decode((tmp_path / "a.jpg").read_bytes())).max() <= 3


def test_orientation():
    tiff = b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x112, 3, 1, 6, 0)
    assert jpeg.orientation(b"\xff\xd8\xff\xe1\0\x20Exif\0\0" + tiff) == 6 and jpeg.orientation(b"\xff\xd8") == 1


def test_files_to_pixels_and_back(spark, tmp_path):
    shots = {"a.png": picture(4), "b.bmp": picture(3), "c.tiff": picture(1)}
    for name, image in shots.items():
        (tmp_path / name).write_bytes(codecs.encode(image, name.split(".")[1]))
    (tmp_path / "d.bin").write_bytes(b"junk")
    files = images.read_files(spark, str(tmp_path))
    assert {r.format for r in files.select(images.sniffed(F.col("content")).alias("format")).collect()} == {"png", "bmp", "tiff", "unknown"}
    assert sorted((r.format, r.error) for r in images.probed(files).collect()) == [("bmp", None), ("png", None), ("tiff", None), ("unknown", "UnknownFormatError")]
    dense = images.decoded(files)
    assert dense.where("error is not null").count() == 1
    pixels = images.to_pixels(dense)
    assert pixels.count() == 3 * 37 * 23
    again = images.to_pixels(images.decoded(images.encoded(images.to_dense(pixels), "png")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pixels.collect()))


def test_stream_of_events_matches_the_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00", float(i % 100)) for i in range(500)]
    batch = spark.createDataFrame(rows, "event_id long, t string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "value")
    batch.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/events")
    query = windows.histogram(stream, late="48 hours").writeStream.outputMode("update").format("memory").queryName("hist").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start, r.bin): r.n for r in spark.table("hist").collect()}
    assert got == {(r.start, r.bin): r.n for r in windows.histogram(batch).collect()}


def test_stream_of_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(codecs.encode(picture(3), "png"))
    files = windows.image_stream(spark, f"{tmp_path}/in").select(F.xxhash64("path").alias("image_id"), "content")
    query = images.probed(files).writeStream.format("memory").queryName("shots").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.width, r.height) for r in spark.table("shots").collect()] == [(37, 23)]


BDF = """STARTFONT 2.1
FONTBOUNDINGBOX 4 4 0 -1
FONT_ASCENT 3
FONT_DESCENT 1
CHARS 2
STARTCHAR A
ENCODING 65
DWIDTH 5 0
BBX 4 3 0 0
BITMAP
60
90
F0
ENDCHAR
STARTCHAR dot
ENCODING 46
DWIDTH 2 0
BBX 1 1 0 0
BITMAP
80
ENDCHAR
ENDFONT
"""


def test_bdf_text():
    font = text.load_bdf(BDF)
    fonts = text.FontSet(font)
    assert font.line_height == 4 and font.has_glyph(65) and not font.has_glyph(66)
    assert text.measure(fonts, "AA\nA.") == {"width": 10, "height": 8, "lines": 2, "glyphs": 4, "missing": 0}
    assert {(y, x) for y, x, _ in text.coverage_rows(fonts, "A")} == {(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)}
    with pytest.raises(CorruptError):
        text.load_bdf("STARTFONT 2.1\nENDFONT")


def test_wrap():
    one = lambda _: 1
    assert text.wrap("the quick brown fox", 9, one) == ["the quick", "brown fox"]
    assert text.wrap("abcdefghij kl", 4, one) == ["abcd", "efgh", "ij", "kl"]
    assert text.wrap("a\n\nb", 4, one) == ["a", "", "b"]
    assert text.ellipsis("abcdefgh", 6, one) == "abc..."
    assert json.dumps(text.wrap("", 4, one)) == '[""]'


def test_psf_text_boxes_and_styles():
    glyphs = bytes([0x18, 0x24, 0x3C, 0x24]) * 256
    font = text.load_font(b"\x36\x04\x00\x04" + glyphs)
    assert font.line_height == 4 and font.glyphs[65].rows == ["00011000", "00100100", "00111100", "00100100"]
    two = struct.pack("<8I", 0x864AB572, 0, 32, 1, 1, 4, 4, 8) + glyphs[:4] + "\u00e9".encode() + b"\xff"
    assert list(text.load_font(two).glyphs) == [0xE9]
    with pytest.raises(RasterError):
        text.load_font(b"\0\1\0\0")
    fonts = text.FontSet(font)
    lines = text.lay_out(fonts, "ab cd ef", text.Box(16, 9, "right", "bottom", "ellipsis"))
    assert [x["y"] for x in lines] == [1, 5] and lines[1]["ellipsized"] and lines[0]["x"] == 0
    rows = text.coverage_rows(fonts, "a")
    assert set(rows) <= set(text.grown(rows, 1)) and max(v for *_, v in text.softened(rows, 1)) < 255
