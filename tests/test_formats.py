"""JPEG against the JVM's codec, lossless WebP, and what the registry says of formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.errors import BoundsError, CorruptError, RangeError, TooLargeError, UnsupportedCodecError, UnsupportedVariantError
from pixelmill.relation import Pixels
from pixelmill.sources import codecs, images, registry, webp


def smooth(h, w, channels, seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    waves = [120 + 60 * np.sin(x / (5 + i) + i) + 50 * np.cos(y / (7 - i)) + rng.normal(0, 4, (h, w)) for i in range(channels)]
    return np.clip(np.stack(waves, -1), 0, 255).astype(np.uint8)


def by_jvm(spark, image, progressive, quality=0.9):
    """A file by the JVM's encoder and its decoder's pixels."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    h, w, channels = image.shape
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if channels == 1 else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    shot = jvm.java.awt.image.BufferedImage(w, h, kind)
    if channels == 1:
        flat = gateway.new_array(jvm.int, w * h)
        for i, v in enumerate(image.ravel().tolist()):
            flat[i] = v
        shot.getRaster().setSamples(0, 0, w, h, 0, flat)
    else:
        for y in range(h):
            for x in range(w):
                r, g, b = image[y, x].tolist()
                shot.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    param.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(shot, None, None), param)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    raster = back.getRaster()
    return data, np.array([[[raster.getSample(x, y, c) for c in range(channels)] for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_of_another_encoder(spark, progressive):
    gray = smooth(27, 35, 1)
    data, want = by_jvm(spark, gray, progressive)
    assert codecs.probe(data).progressive == progressive
    assert np.abs(codecs.decode(data).astype(int) - want).max() <= 1
    color = smooth(21, 18, 3)
    data, want = by_jvm(spark, color, progressive)
    got = codecs.decode(data).astype(int)
    assert got.shape == want.shape and np.abs(got - want).mean() < 1.5  # chroma is enlarged in another way
    assert np.abs(got - color).mean() < 8


def test_jpeg_of_rgb_and_four_components():
    image = smooth(16, 16, 3)
    data = codecs.encode(image, "jpeg")
    at = data.index(b"\xff\xc0")
    named = bytearray(data)
    for i, c in enumerate(b"RGB"):  # ids R, G and B: the components are colours
        named[at + 10 + 3 * i] = c
        named[data.index(b"\xff\xda") + 5 + 2 * i] = c
    plain = codecs.decode(bytes(named)).astype(int)
    marked = data[:2] + b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00\x00" + data[2:]
    assert (codecs.decode(marked) == plain).all() and (plain != codecs.decode(data)).any()
    with pytest.raises(UnsupportedVariantError):
        codecs.decode(data.replace(b"\xff\xc0", b"\xff\xc3", 1))
    with pytest.raises(CorruptError):
        codecs.decode(data[: data.index(b"\xff\xda")])


@pytest.mark.parametrize("shape", [(1, 1, 3), (1, 9, 4), (11, 1, 3), (33, 21, 4), (130, 5, 3)])
def test_webp_round_trip(shape):
    rng = np.random.default_rng(5)
    for image in (rng.integers(0, 256, shape).astype(np.uint8), np.full(shape, 9, np.uint8), smooth(*shape)):
        data = codecs.encode(image, "webp")
        assert codecs.sniff(data) == "webp" and (codecs.decode(data) == image).all()
        info = codecs.probe(data)
        assert (info.width, info.height, info.channels) == (shape[1], shape[0], shape[2])


class Stream(webp._Writer):
    """A lossless body by hand."""

    def __init__(self, w, h, alpha=0):
        super().__init__()
        for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (alpha, 1), (0, 3)):
            self.put(value, n)

    def one(self, symbol):
        """A code of a single symbol."""
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.put(value, n)

    def file(self):
        body = self.done()
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def test_webp_palette_of_bits_and_references():
    # colours 2 and 1 more; eight pixels in a byte: 0b10110010 from the left is 0, 1, 0, 0, 1, 1, 0, 1
    s = Stream(8, 1)
    s.put(1 | 3 << 1, 3)
    s.put(1, 8)  # two colours
    s.put(0, 1)  # no cache
    s.put(1, 1), s.put(1, 1), s.put(1, 1), s.put(10, 8), s.put(20, 8)  # green: 10, then 20 more
    s.one(0), s.one(0), s.one(255), s.one(0)
    s.put(0, 1), s.put(1, 1)
    s.put(0, 1)  # no more transforms
    s.put(0, 1), s.put(0, 1)
    s.one(0b10110010), s.one(0), s.one(0), s.one(0), s.one(0)
    assert codecs.decode(s.file())[0, :, 1].tolist() == [10, 30, 10, 10, 30, 30, 10, 30]
    with pytest.raises(UnsupportedCodecError):
        codecs.decode(b"RIFF\x20\0\0\0WEBPVP8 " + bytes(24))
    with pytest.raises(CorruptError):
        codecs.decode(codecs.encode(smooth(20, 20, 3), "webp")[:60])


def test_webp_predictions_and_colours():
    left, top, corner, right = (np.array([v]) for v in ([10, 20, 30, 40], [50, 60, 70, 80], [20, 30, 40, 50], [90, 10, 20, 30]))
    got = [webp.predicted(m, left, top, corner, right).tolist()[0] for m in range(14)]
    assert got == [
        [255, 0, 0, 0], [10, 20, 30, 40], [50, 60, 70, 80], [90, 10, 20, 30], [20, 30, 40, 50], [50, 37, 47, 57], [15, 25, 35, 45], [30, 40, 50, 60], [35, 45, 55, 65], [70, 35, 45, 55], [42, 30, 40, 50],
        [50, 60, 70, 80], [40, 50, 60, 70], [35, 45, 55, 65],
    ]
    assert webp.plane_codes()[:8] == bytes([0x18, 0x07, 0x17, 0x19, 0x28, 0x06, 0x27, 0x29]) and len(webp.plane_codes()) == 120
    table, data = np.array([[[255, 7, 250, 3]]]), np.array([[[255, 100, 64, 20]]])  # red to blue 7, green to blue -6, green to red 3
    assert webp._uncrossed(data, table, 2).tolist() == [[[255, 100 + (3 * 64 >> 5), 64, 20 + (-6 * 64 >> 5) + (7 * 106 >> 5)]]]


def test_registry(spark):
    names = spark.range(0, 10).select(registry.format_name(F.col("id")).alias("n")).collect()
    assert [r.n for r in names] == ["unknown", "png", "jpeg", "bmp", "gif", "tiff", "webp", "avif", "heif", "unknown"]
    ends = spark.createDataFrame([("jpeg",), ("heif",), ("x",)], "f string").select(registry.format_extension(F.col("f")).alias("e")).collect()
    assert [r.e for r in ends] == [".jpg", ".heic", ""]
    with pytest.raises(Exception, match="unknown format"):
        spark.createDataFrame([("x",)], "f string").select(registry.image_extension(F.col("f"))).collect()
    assert registry.codec_count() == 7 and registry.codec_at(0) == "jpeg" and registry.codec_at(7) is None and registry.codec_find("heif") is None
    assert [registry.encode_level(c, q) for c, q in (("auto", 89), ("auto", 90), ("none", 95), ("best", 1))] == ["default", "best", "huffman", "best"]
    assert registry.resolve_decode(100, 50, 90, 10, 40, 0, 4) == ((90, 10, 10, 40), 4, (3, 10))
    assert registry.resolve_decode(9, 9, den=3) == ((0, 0, 9, 9), 1, (9, 9))
    with pytest.raises(BoundsError):
        registry.resolve_decode(8, 8, 8, 0)
    with pytest.raises(TooLargeError):
        registry.resolve_decode(5000, 5000)
    assert registry.resolve_decode(5000, 5000, den=2)[2] == (2500, 2500)


def test_channels_convert(spark):
    spark.sql("SELECT 1L AS image_id, 0L AS y, 0L AS x, 10L AS r, 200L AS g, 30L AS b, 77L AS a").createOrReplaceTempView("one_pixel")
    p = Pixels("SELECT * FROM one_pixel", 1, 1)
    gray = (13933 * 10 + 46871 * 200 + 4732 * 30 + 32768) >> 16
    got = lambda s, d: tuple(spark.sql(registry.converted(p, s, d).sql).first())[3:]
    assert got(4, 4) == (10, 200, 30, 77) and got(4, 3) == (10, 200, 30, 255) and got(4, 2) == (gray,) * 3 + (77,) and got(3, 4)[3] == 255 and got(1, 3) == (10, 10, 10, 255) and got(2, 4) == (10, 10, 10, 77)
    with pytest.raises(RangeError):
        registry.converted(p, 5, 1)


def test_code_lengths_are_the_cheapest_in_bounds():
    rng = np.random.default_rng(2)
    for _ in range(20):
        f = rng.integers(0, 40, 9).tolist()
        for limit in (4, 5, 15):
            got = registry.huffman_lengths(f, limit)
            assert max(got) <= limit and sum(2.0**-n for n in got if n) <= 1 and all((n > 0) == (v > 0) for n, v in zip(got, f))
    fib = [1, 1, 2, 3, 5, 8, 13, 21]
    assert sum(a * b for a, b in zip(fib, registry.huffman_lengths(fib, 15))) == 132  # merges of 2, 4, 7, 12, 20, 33 and 54
    assert registry.huffman_lengths(fib, 4) == [4, 4, 4, 4, 3, 3, 2, 2] and registry.huffman_lengths([0, 3, 0], 2) == [0, 1, 0] and registry.huffman_lengths([0, 0], 1) == [0, 0]
    with pytest.raises(RangeError):
        registry.huffman_lengths([1] * 9, 3)


def test_sniffing_reads_compatible_brands(spark):
    box = lambda *brands: (16 + 4 * len(brands[1:])).to_bytes(4, "big") + b"ftyp" + brands[0] + b"\0\0\0\0" + b"".join(brands[1:])
    files = [(1, box(b"mif1", b"miaf", b"avif")), (2, box(b"mif1", b"heic")), (3, box(b"avis")), (4, box(b"isom", b"mp42")), (5, b"GIF89a"), (6, b"GIF8"), (7, box(b"mif1") + b"avif")]
    got = {r.id: r.f for r in spark.createDataFrame(files, "id int, c binary").select("id", images.sniffed(F.col("c")).alias("f")).collect()}
    assert got == {1: "avif", 2: "heif", 3: "avif", 4: "unknown", 5: "gif", 6: "unknown", 7: "heif"}
    assert {i: codecs.sniff(c) for i, c in files} == got
