"""Images as rows: files read as binaries, dense rows, pixels, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.errors import RangeError
from pixelmill.sources import codecs

DENSE = "image_id long, width int, height int, channels int, format string, data binary, error string"
_DENSE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
PROBE = "image_id long, width int, height int, frames int, format string, channels int, bit_depth int, has_alpha boolean, progressive boolean, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """image_id (a hash of the path), path and content of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def read_image_source(spark: SparkSession, path: str) -> DataFrame:
    """Dense rows through the JVM's decoders (JPEG with progressive scans, PNG, BMP, GIF); unreadable files are left out."""
    shot = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}

    def make(origin, w, h, c, data):
        import numpy as np

        flat = np.frombuffer(data, np.uint8).reshape(h, w, c)[..., order[c]]
        return origin, w, h, c, None, np.ascontiguousarray(flat).tobytes(), None

    rows = shot.select(F.xxhash64("origin").alias("image_id"), "width", "height", "nChannels", "data")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
    return _rows(rows, [c.split()[0] for c in DENSE.split(", ")], kinds, DENSE, make)


def sniffed(content: Column) -> Column:
    """The format by the first bytes, as an expression in the JVM."""
    brand = F.substring(content, 9, 4)
    # any brand of the list, behind the version at the fourth place, makes an AVIF file, but only the major one a HEIF file
    size = F.least(F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long"), F.length(content).cast("long"))
    places = F.sequence(F.lit(9).cast("long"), F.greatest(F.lit(9).cast("long"), size - 3), F.lit(4).cast("long"))
    listed = F.exists(places, lambda i: (i != 13) & (i + 3 <= size) & content.substr(i.cast("int"), F.lit(4)).isin(*(F.lit(b) for b in codecs.AVIF_BRANDS)))
    boxed = (F.length(content) >= 12) & (F.substring(content, 5, 4) == F.lit(b"ftyp"))
    out = F.when(boxed & listed, "avif").when(boxed & brand.isin(*(F.lit(b) for b in codecs.HEIF_BRANDS)), "heif").otherwise("unknown")
    out = F.when((F.substring(content, 1, 4) == F.lit(b"RIFF")) & (brand == F.lit(b"WEBP")), "webp").otherwise(out)
    for name, head in reversed(codecs.MAGIC):
        out = F.when(F.substring(content, 1, len(head)) == F.lit(head), name).otherwise(out)
    return out


def _rows(df: DataFrame, names: list[str], kinds: list[pa.DataType], schema: str, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                rows.append(make(*row))
                if len(rows) == 16:  # images are large: small batches keep memory at a few of them
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def probed(files: DataFrame) -> DataFrame:
    """Header facts of (image_id, content); what cannot be read has its error's name."""

    def make(image_id, content):
        try:
            i = codecs.probe(content or b"")
            return image_id, i.width, i.height, int(i.frames), i.format, i.channels, i.bit_depth, bool(i.has_alpha), i.progressive, None
        except ValueError as e:
            return image_id, None, None, None, codecs.sniff(content or b""), None, None, None, None, type(e).__name__

    names = [c.split()[0] for c in PROBE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    return _rows(files.select("image_id", "content"), names, kinds, PROBE, make)


def decoded(files: DataFrame, region: tuple[int, int, int, int] | None = None, den: int = 1) -> DataFrame:
    """Dense rows of (image_id, content); a region and a reduction by block means are applied before pixels leave the worker."""

    def make(image_id, content):
        try:
            image = codecs.decode(content or b"", region[1] + region[3] if region else None)
            if region:
                x, y, w, h = region
                image = image[y : y + h, x : x + w]
            if den > 1:
                import numpy as np

                h, w, c = image.shape
                ys, xs = np.arange(0, h, den), np.arange(0, w, den)
                total = np.add.reduceat(np.add.reduceat(image.astype(np.uint32), ys, 0), xs, 1)
                n = np.diff(ys, append=h)[:, None, None] * np.diff(xs, append=w)[None, :, None]
                image = ((total + n // 2) // n).astype(np.uint8)
            h, w, c = image.shape
            return image_id, w, h, c, codecs.sniff(content), image.tobytes(), None
        except ValueError as e:
            return image_id, None, None, None, codecs.sniff(content or b""), None, type(e).__name__

    names = [c.split()[0] for c in DENSE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
    return _rows(files.select("image_id", "content"), names, kinds, DENSE, make)


def to_pixels(dense: DataFrame) -> DataFrame:
    """One row per pixel: image_id, y, x, r, g, b, a; grey is spread to three channels, missing alpha is 255."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for image_id, w, h, c, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                flat = np.frombuffer(data, np.uint8).reshape(-1, c).astype(np.int64)
                color = flat[:, :3] if c >= 3 else np.repeat(flat[:, :1], 3, 1)
                alpha = flat[:, -1] if c in (2, 4) else np.full(len(flat), 255, np.int64)
                for i in range(0, len(flat), 1 << 16):
                    n = np.arange(i, min(len(flat), i + (1 << 16)))
                    cols = [np.full(len(n), image_id, np.int64), n // w, n % w, *(np.ascontiguousarray(color[n, j]) for j in range(3)), alpha[n]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["image_id", "y", "x", "r", "g", "b", "a"])

    return dense.where("data is not null").select("image_id", "width", "height", "channels", "data").mapInArrow(run, "image_id long, y long, x long, r long, g long, b long, a long")


def to_dense(pixels: DataFrame, channels: int = 4) -> DataFrame:
    """Dense rows from pixels: one Arrow group per image, bounded by one image."""
    names = ["r", "g", "b", "a"][:channels] if channels >= 3 else ["r", "a"][:channels]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, h, w = image_array(table, names)
        body = data.astype("uint8").tobytes()
        columns = [[key[0].as_py()], [w], [h], [channels], [None], [body], [None]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, _DENSE_KINDS, strict=True)], names=[c.split()[0] for c in DENSE.split(", ")])

    return pixels.groupBy("image_id").applyInArrow(run, DENSE)


def image_array(table: pa.Table, names: Sequence[str]):
    """Samples of one image's pixels as an array (pixels in order, names), its height and its width."""
    import numpy as np

    y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
    order = np.lexsort((x, y))
    return np.stack([table.column(c).to_numpy()[order] for c in names], 1), int(y.max()) + 1, int(x.max()) + 1


def encoded(dense: DataFrame, kind: str, colors: int | None = None) -> DataFrame:
    """image_id, format and content of dense rows; ``colors`` quantises by median cut first (for GIF)."""

    def make(image_id, w, h, c, data):
        import numpy as np

        image = np.frombuffer(data, np.uint8).reshape(h, w, c)
        return image_id, kind, codecs.encode(codecs.median_cut(image, colors) if colors else image, kind)

    return _rows(dense.where("data is not null").select("image_id", "width", "height", "channels", "data"), ["image_id", "format", "content"], [pa.int64(), pa.string(), pa.binary()], "image_id long, format string, content binary", make)


def with_quality(rows: DataFrame, quality: int) -> DataFrame:
    """Remember the quality that an encoder should use, 0 (its own) to 100."""
    if not 0 <= quality <= 100:
        raise RangeError("quality")
    return rows.withColumn("quality", F.lit(quality))


def artifact_key(origin: str, content: Column, options: dict[str, object]) -> Column:
    """A cache key: origin, SHA-256 of the bytes and the options in order."""
    query = "&".join(f"{k}={options[k]}" for k in sorted(options))
    return F.concat(F.lit(origin), F.sha2(content, 256), F.lit("?" + query if query else ""))
