"""Registered queries that are not projections of the fixture images: streams, codecs, text, plans, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill import oracles
from pixelmill.catalog import spark_query
from pixelmill.functions import color as C
from pixelmill.operators import analysis, geometry, metadata, resample, stencil, text, tone
from pixelmill.plans import cost, lattice, transform
from pixelmill.plans.ir import Plan
from pixelmill.relation import Pixels, fixture
from pixelmill.sources import images, registry
from pixelmill.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_query(lambda p: p)(spark, sf_dir)


def _round_trip(kind: str, colors: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images.to_pixels(images.decoded(images.encoded(images.to_dense(pixels(spark, sf_dir)), kind, colors)))

    return run


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = images.encoded(images.to_dense(pixels(spark, sf_dir)), "png")
    return images.to_pixels(images.decoded(files, region=(1, 0, 7, 6), den=4))


def _sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = images.to_dense(pixels(spark, sf_dir))
    parts = [images.encoded(dense, k).select("image_id", images.sniffed(F.col("content")).alias("format")) for k in ("png", "bmp", "tiff")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("format").agg(F.count("*").alias("n"))


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = images.to_dense(pixels(spark, sf_dir))
    both = images.encoded(dense, "png").unionByName(images.encoded(dense, "bmp"))
    return images.probed(both).select("image_id", F.col("width").cast("long"), F.col("height").cast("long"), "format", F.col("channels").cast("long"), "has_alpha")


def _crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.crc32("text").alias("crc"))


def _adler(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zlib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.adler32((x or "").encode()) for x in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "adler"])

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").mapInArrow(run, "doc_id long, adler long")


def _bytes_sql() -> str:
    """The UTF-8 bytes of each document as a list of numbers."""
    return "SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents"


def _adler_sql() -> str:
    """Sums of the bytes, and of the running sums, modulo the largest prime below 2 ** 16."""
    sums = "1 + coalesce(list_sum(bytes), 0) AS a, len(bytes) + coalesce(list_sum(list_transform(bytes, lambda v, i: v * (len(bytes) - i + 1))), 0) AS b"
    return f"SELECT doc_id, CAST(coalesce((b % 65521) * 65536 + a % 65521, 1) AS BIGINT) AS adler FROM (SELECT doc_id, {sums} FROM ({_bytes_sql()}) t) s"


def _crc_sql() -> str:
    """The division by the polynomial 0xEDB88320, a byte at a time through the remainders of all bytes."""
    table = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    rest = "[" + ",".join(map(str, table)) + "]::BIGINT[]"
    step = "lambda c, v: xor(c >> 8, list_extract(t, CAST(xor(c, v) & 255 AS INTEGER) + 1))"
    return f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), {step}), 4294967295::BIGINT) AS BIGINT) END AS crc FROM (SELECT *, {rest} AS t FROM ({_bytes_sql()}) d) q"


def _histogram(slide: str | None) -> Query:
    return lambda spark, sf_dir: windows.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour", slide)


_BIN = "CAST(least(15, greatest(0, floor(value * 16 / 100.0e0))) AS BIGINT)"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    meta = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    changed = metadata.remove_entry(metadata.set_entry(metadata.set_entry(meta, "type", "x"), "id", "7"), "user")
    return rows.select("event_id", metadata.get_entry(changed, "type").alias("kind"), metadata.get_entry(changed, "id").alias("extra"), metadata.has_entry(changed, "user").alias("has_user"), metadata.entry_count(changed).cast("long").alias("n"))


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40).select("doc_id", F.col("line").cast("long").alias("line"), "content", "width")


def _chain(p: Pixels, fusion: bool = True) -> Pixels:
    plan = Plan(p.width, p.height, fusion=fusion).crop(1, 1, 6, 6).rotate(90).rotate(270).flip_h().brightness(1.0).invert().invert().crop(0, 1, 5, 5).grayscale().hue(40).blur(1)
    return plan.apply(p)


_ENCODERS = [(f, w, h, q, ll, al, fast) for f in ("png", "jpeg", "webp", "avif", "bmp") for w, h in ((100, 80), (1920, 1080)) for q in (0, 60, 87) for ll in (0, 1) for al in (0, 1) for fast in (0, 1)]


def _encode_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_ENCODERS)], "i long, f string, w long, h long, q long, ll long, al long, fast long")
    args = (F.col("f"), F.col("w"), F.col("h"), F.col("q"), F.col("ll") == 1, F.col("al") == 1, F.col("fast") == 1)
    return rows.select("i", cost.encode_cost(*args).alias("point"), cost.encode_cost(*args, upper=True).alias("upper"))


def _encode_cost_sql() -> str:
    def case(table: dict, other: int) -> str:
        return "CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"

    rows = ",".join(f"({i},'{r[0]}',{','.join(map(str, r[1:]))})" for i, r in enumerate(_ENCODERS))
    quality = "CASE f " + " ".join(f"WHEN '{k}' THEN CASE WHEN 2*q <= 125 THEN {v[0]} WHEN 2*q <= 160 THEN {v[1]} WHEN 2*q <= 175 THEN {v[2]} WHEN 2*q <= 185 THEN {v[3]} ELSE {v[4]} END" for k, v in cost.QUALITY.items()) + " ELSE 1000 END"
    a, b, c = cost.LOSSLESS_WEBP
    return f"""WITH t AS (SELECT * FROM (VALUES {rows}) v(i,f,w,h,q,ll,al,fast)),
s0 AS (SELECT *, CAST(w AS BIGINT)*h*({case(cost.ENCODE, 0)}) // 1000000 AS c FROM t),
s1 AS (SELECT *, CASE WHEN ll=1 AND f='webp' THEN c*(CASE WHEN w*h>=1000000 THEN {c} WHEN w*h>=100000 THEN {b} ELSE {a} END)//1000 WHEN q>0 THEN c*({quality})//1000 ELSE c END AS c1 FROM s0),
s2 AS (SELECT *, CASE WHEN al=1 THEN c1*({case(cost.ALPHA, 1000)})//1000 ELSE c1 END AS c2 FROM s1),
s3 AS (SELECT *, CASE WHEN fast=1 AND NOT (ll=1 AND f='webp') THEN c2*({case(cost.FAST_ENCODE, 1000)})//1000 ELSE c2 END AS c3 FROM s2)
SELECT CAST(i AS BIGINT) AS i, CAST(c3 AS BIGINT) AS point, CAST(c3*({case(cost.UPPER_ENCODE, 1000)})//1000 AS BIGINT) AS upper FROM s3"""


# Rows that stand for a calibration; a deployment passes its own tables.
_LEVER = [(f, e, s, st, 60.0 - 6 * e - 4 * s - 5 * st) for f in ("jpeg", "webp") for e in (0, 1) for s in (0, 1) for st in (0, 1, 2)]
_ENCODE = [(f, q, round(0.05 + q / 400 + (0.02 if f == "jpeg" else 0), 4), 20.0 + q / 4) for f in ("jpeg", "webp") for q in (50, 75, 85, 90, 95)]
_VARIANTS = [(i, f, q, f != "jpeg", True, 100 + 10 * i) for i, (f, q) in enumerate([(f, q) for f in ("jpeg", "webp") for q in (50, 75, 85, 90, 95)])]


def _select(objective: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        lattice = spark.createDataFrame([(i, i % 2, i // 2 % 2, i // 4) for i in range(12)], "candidate int, effort int, filter int, steps int")
        cand = orders.select(F.col("o_orderkey").alias("request"), F.floor("o_totalprice").cast("long").alias("base")).crossJoin(F.broadcast(lattice))
        cand = cand.select("request", "candidate", "effort", "filter", "steps", (F.col("base") - F.col("candidate") * 500).alias("cost_upper_us"), (F.col("base") * 100).alias("peak_bytes"))
        variants = spark.createDataFrame(_VARIANTS, "variant int, format string, quality int, alpha_ok boolean, allowed boolean, upper_us long")
        lever = F.broadcast(spark.createDataFrame(_LEVER, "format string, effort int, filter int, steps int, lever_db double"))
        encode = F.broadcast(spark.createDataFrame(_ENCODE, "format string, quality int, bytes_per_pixel double, encode_db double"))
        got = cost.select(cand, variants, lever, encode, objective, min_db=38.0, budget_us=200_000, peak_cap=25_000_000)
        return got.select("request", F.col("candidate").cast("long").alias("candidate"), F.col("variant").cast("long").alias("variant"), "format", F.col("total_us").cast("long").alias("total_us"))

    return run


def _select_sql(objective: str) -> str:
    tuples = lambda rows: ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}e0" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    order = {"min_bytes": "bpp, total_us", "min_time": "total_us, bpp", "max_quality": "-db, bpp"}[objective]
    return f"""WITH l AS (SELECT * FROM (VALUES {tuples(_LEVER)}) v(format,effort,filter,steps,lever_db)), e AS (SELECT * FROM (VALUES {tuples(_ENCODE)}) v(format,quality,bpp,encode_db)),
v AS (SELECT * FROM (VALUES {tuples(_VARIANTS)}) v(variant,format,quality,alpha_ok,allowed,upper_us)), k AS (SELECT range AS candidate, range % 2 AS effort, range // 2 % 2 AS filter, range // 4 AS steps FROM range(12)),
s AS (SELECT o_orderkey AS request, candidate, variant, v.format, floor(o_totalprice) - candidate * 500 + upper_us AS total_us, floor(o_totalprice) * 100 AS peak, bpp, round(least(99e0, -10 * log10(pow(10e0, -lever_db / 10) + pow(10e0, -encode_db / 10))), 9) AS db
 FROM orders CROSS JOIN k CROSS JOIN v JOIN l USING (format, effort, filter, steps) JOIN e ON e.format = v.format AND e.quality = v.quality)
SELECT CAST(request AS BIGINT) AS request, CAST(candidate AS BIGINT) AS candidate, CAST(variant AS BIGINT) AS variant, format, CAST(total_us AS BIGINT) AS total_us
FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {order}, candidate, variant) AS n FROM s WHERE db >= 38 AND total_us <= 200000 AND peak <= 25000000) q WHERE n = 1"""


def _space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of candidates and variants for each order, with its price, size and distortion."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lattice_ = spark.createDataFrame([(i, i % 2, i // 2 % 2, i // 4) for i in range(12)], "candidate long, effort int, filter int, steps long")
    variants = spark.createDataFrame([(*v[:3], v[3], v[2] != 50, v[5]) for v in _VARIANTS], "variant long, format string, quality int, alpha_ok boolean, allowed boolean, upper_us long")
    lever = spark.createDataFrame([r for r in _LEVER if r[3] < 2 or r[0] == "jpeg"], "format string, effort int, filter int, steps long, lever_db double")
    encode = spark.createDataFrame(_ENCODE, "format string, quality int, bytes_per_pixel double, encode_db double")
    table = lattice_.crossJoin(variants).join(lever, ["format", "effort", "filter", "steps"], "left").join(encode, ["format", "quality"])  # 120 rows
    db = F.round(-10 * F.log10(F.pow(F.lit(10.0), -F.col("lever_db") / 10) + F.pow(F.lit(10.0), -F.col("encode_db") / 10)), 9)
    table = table.select("candidate", "variant", "format", "steps", "allowed", "alpha_ok", "upper_us", "bytes_per_pixel", db.alias("db"))
    base = orders.select(F.col("o_orderkey").alias("request"), F.floor("o_totalprice").cast("long").alias("base"))
    space = base.crossJoin(F.broadcast(table))  # a fixed table of 120 rows
    return space.withColumn("total_us", F.col("base") - F.col("candidate") * 500 + F.col("upper_us")).withColumn("peak_bytes", F.col("base") * 100)


def _tuples(rows) -> str:
    one = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}e0" if isinstance(v, float) else str(v)
    return ",".join("(" + ",".join(map(one, r)) + ")" for r in rows)


def _space_sql() -> str:
    lever = _tuples(r for r in _LEVER if r[3] < 2 or r[0] == "jpeg")
    return f"""WITH l AS (SELECT * FROM (VALUES {lever}) v(format, effort, filter, steps, lever_db)), e AS (SELECT * FROM (VALUES {_tuples(_ENCODE)}) v(format, quality, bpp, encode_db)),
v AS (SELECT * FROM (VALUES {_tuples(_VARIANTS)}) v(variant, format, quality, alpha_ok, allowed_, upper_us)),
s AS (SELECT o_orderkey AS request, k AS candidate, variant, v.format, k // 4 AS steps, v.quality <> 50 AS allowed, alpha_ok, CAST(floor(o_totalprice) AS BIGINT) - k * 500 + upper_us AS total_us, CAST(floor(o_totalprice) AS BIGINT) * 100 AS peak, bpp,
 round(-10 * log10(pow(10e0, -lever_db / 10) + pow(10e0, -encode_db / 10)), 9) AS db
 FROM orders CROSS JOIN range(12) k_(k) CROSS JOIN v LEFT JOIN l ON l.format = v.format AND l.effort = k % 2 AND l.filter = k // 2 % 2 AND l.steps = k // 4 JOIN e ON e.format = v.format AND e.quality = v.quality)"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cost.considered(_space(spark, sf_dir), min_db=36.0, budget_us=150_000, peak_cap=20_000_000, alpha=True)
    return got.groupBy("request", "reason").agg(F.count("*").alias("n"))


def _chosen(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = _space(spark, sf_dir).where("db >= 36 and total_us <= 150000")
        got = lattice.select_ladder(space, "webp") if how == "ladder" else lattice.select_independent(space)
        return got.select("request", "candidate", "variant", "format", "total_us")

    return run


_SELECTED = "SELECT request, candidate, variant, format, total_us FROM"
_REASON_SQL = "CASE WHEN NOT allowed THEN 'format' WHEN NOT alpha_ok THEN 'alpha' WHEN db IS NULL THEN 'uncharacterized' WHEN peak > 20000000 THEN 'peak' WHEN db < 36 THEN 'quality' WHEN total_us > 150000 THEN 'budget' ELSE 'none' END"
_INDEPENDENT_SQL = "(SELECT s.*, row_number() OVER (PARTITION BY s.request ORDER BY s.total_us, s.candidate, s.variant) AS n FROM s JOIN (SELECT request, arg_min(format, (bpp, variant)) AS best FROM s WHERE db >= 36 AND total_us <= 150000 GROUP BY request) b ON b.request = s.request AND b.best = s.format WHERE db >= 36 AND total_us <= 150000) q WHERE n = 1"


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("plan_upper_us"), (F.col("o_custkey") * 7).alias("encode_upper_us"), F.lit(120_000).cast("long").alias("budget_us"))
    return cost.admit(rows, 850).select("o_orderkey", "decision")


_READS = [(f, w, h, n, x, y, d, late, fast) for f in ("png", "jpeg", "tiff", "webp", "gif") for w, h, n in ((1200, 900, 400_000), (640, 480, 3_000_000)) for x, y in ((0, 0), (100, 50)) for d in (1, 2, 8) for late in (0, 1) for fast in (0, 1)]


def _read_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = lambda f, w, h, n, x, y, d, late, fast: cost.decode_cost(cost.Source(f, n, 3, bool(late)), w, h, (x, y, 300, 200), d, bool(fast))
    return spark.createDataFrame([(i, price(*r)) for i, r in enumerate(_READS)], "i long, micros long")


def _read_costs_sql() -> str:
    """Rates as rows; a region of 300 x 200 is traversed alone, down to its last row, or with the whole picture."""
    rate = [(f, late, d, cost.READ[f][late][i]) for f in cost.READ for late in (0, 1) for i, d in enumerate((1, 2, 4, 8))]
    taken = [(f, late, d, cost.CONSUMED[f][late][i]) for f in cost.CONSUMED for late in (0, 1) for i, d in enumerate((1, 2, 4, 8))]
    quick = [(f, d, cost.FAST_READ[f][i]) for f in cost.FAST_READ for i, d in enumerate((1, 2, 4, 8))]
    reads = _tuples((i, *r) for i, r in enumerate(_READS))
    return f"""WITH t AS (SELECT i, f, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(n AS BIGINT) AS n, x, y, d, late, fast FROM (VALUES {reads}) v(i, f, w, h, n, x, y, d, late, fast)),
r AS (SELECT t.*, rate, coalesce(part, 1000) AS part, CASE WHEN fast = 1 THEN coalesce(q.k, 1000) ELSE 1000 END AS k, CASE WHEN late = 1 OR f = 'gif' THEN 'all' WHEN f IN ('png', 'webp') THEN 'rows' ELSE 'region' END AS reach,
 CASE f WHEN 'png' THEN 7907 WHEN 'webp' THEN 75758 WHEN 'tiff' THEN CASE WHEN n * 1000 >= w * h * 3 * 900 THEN 0 ELSE 3986 END WHEN 'jpeg' THEN CASE late WHEN 1 THEN 13199 ELSE 15483 END ELSE 0 END AS per
 FROM t JOIN (VALUES {_tuples(rate)}) a(fa, late_a, da, rate) ON a.fa = t.f AND a.da = t.d AND a.late_a = CASE WHEN t.f = 'jpeg' THEN t.late ELSE 0 END
 LEFT JOIN (VALUES {_tuples(taken)}) c(fc, late_c, dc, part) ON c.fc = t.f AND c.dc = t.d AND c.late_c = CASE WHEN t.f = 'jpeg' THEN t.late ELSE 0 END LEFT JOIN (VALUES {_tuples(quick)}) q(fq, dq, k) ON q.fq = t.f AND q.dq = t.d)
SELECT CAST(i AS BIGINT) AS i, CAST(((CASE reach WHEN 'all' THEN w * h WHEN 'rows' THEN w * (y + 200) ELSE 300 * 200 END)::BIGINT * rate // 1000000 + (CASE WHEN reach = 'rows' THEN (n::BIGINT * part // 1000) * (y + 200) // h ELSE n::BIGINT * part // 1000 END) * per // 1000000) * k // 1000 AS BIGINT) AS micros FROM r"""


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 10).alias("number"))
    return rows.select("event_id", registry.format_name(F.col("number")).alias("name"), registry.format_extension(registry.format_name(F.col("number"))).alias("extension"))


def _transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = images.encoded(images.to_dense(pixels(spark, sf_dir)), "png")
    return images.to_pixels(images.decoded(transform.transform(files, 8, 8, to="webp", crop=(1, 1, 6, 4), rotate=90, invert=True)))


_IDS = "(SELECT DISTINCT vec_id // 4 AS image_id FROM embeddings) ids"


def _gif_sql() -> str:
    """GIF keeps colours exactly where alpha is 128 or more and clears the rest."""
    body = ", ".join(f"CASE WHEN a < 128 THEN 0 ELSE {c} END AS {c}" for c in "rgb")
    return f"SELECT image_id, y, x, {body}, CASE WHEN a < 128 THEN 0 ELSE 255 END AS a FROM ({fixture('duck').sql}) q"


def _region_sql() -> str:
    return resample.reduce(geometry.crop(fixture("duck"), 1, 0, 7, 6), 4).sql


def _duck_pixels() -> str:
    return fixture("duck").sql


def _chain_sql() -> str:
    return f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({_chain(fixture('duck'), False).sql}) q"


def _eager(p: Pixels) -> Pixels:
    """What the plan of ``plan_tone`` comes to, operator by operator."""
    p = stencil.gaussian_blur(tone.matrix(p, C.contrast(1.2)), 1.0)
    p = stencil.despeckle(tone.matrix(p, C.saturation(0.5)))
    p = stencil.dilate(tone.curve(p, "gamma", 1.4), 1)
    p = stencil.box_blur(tone.curve(p, "levels", 20, 230, 1.2, 0, 255), 1)
    return tone.matrix(p, C.square((0.5, 0.5, 0, 0, 1, 0, 0.2, 0, 0.8)))


def _planned(p: Pixels) -> Pixels:
    plan = Plan(8, 8).contrast(1.2).gaussian_blur(1.0).saturation(0.5).effect("median").gamma(1.4).effect("dilate", 1).curve("levels", 20, 230, 1.2, 0, 255).blur(1)
    return plan.matrix(C.square((0.5, 0.5, 0, 0, 1, 0, 0.2, 0, 0.8))).apply(p)


_PLANS = {
    "turns": lambda: Plan(400, 200).rotate(90).rotate(270).brightness(1.0).invert(),
    "crops": lambda: Plan(400, 200).crop(10, 20, 100, 100).contrast(2).crop(5, 5, 50, 0),
    "thumbnail": lambda: Plan(1600, 1200).crop(0, 0, 800, 800).brightness(1.1).gamma(2).resize(90, 90),
    "barrier": lambda: Plan(400, 200).flip_h().blur(3).flip_h().grayscale().hue(40),
    "fitted": lambda: Plan(400, 200).fit(100, 100, "cover").rotate(90),
}


def _resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, make in _PLANS.items():
        plan = make()
        got = plan.resolve()
        rows.append((name, len(plan.ops), ",".join(op.kind for op in got.ops), got.width, got.height, got.channels, got.stages, got.den, str(got.region or "")))
    return spark.createDataFrame(rows, "name string, appended long, ops string, width long, height long, channels long, stages long, den long, region string")


_RESOLUTIONS = """SELECT name, CAST(COLUMNS(['appended', 'width', 'height', 'channels', 'stages', 'den']) AS BIGINT), ops, region FROM (VALUES
 ('turns', 4, 'invert', 400, 200, 4, 1, 1, ''), ('crops', 3, 'crop,contrast', 50, 95, 4, 1, 1, '(15, 25, 50, 95)'), ('thumbnail', 4, 'crop,brightness,gamma,resize', 90, 90, 4, 1, 8, '(0, 0, 800, 800)'),
 ('barrier', 5, 'flip_h,blur,flip_h,grayscale', 400, 200, 2, 1, 1, ''), ('fitted', 2, 'fit,rotate', 100, 100, 4, 0, 1, '')) v(name, appended, ops, width, height, channels, stages, den, region)"""


def _exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    tagged = metadata.set_exif(rows.where("event_id % 3 > 0"), b"II*\x00").unionByName(metadata.strip_exif(metadata.set_exif(rows.where("event_id % 3 = 0"), b"x")))
    return tagged.select("event_id", metadata.has_exif(tagged).alias("tagged"), F.length(metadata.get_exif(tagged)).cast("long").alias("bytes"))


_SPECS: dict[str, tuple[Query, str | None]] = {
    "png_roundtrip": (_round_trip("png"), _duck_pixels()),
    "bmp_roundtrip": (_round_trip("bmp"), _duck_pixels()),
    "tiff_roundtrip": (_round_trip("tiff"), _duck_pixels()),
    "gif_roundtrip": (_round_trip("gif"), f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({_gif_sql()}) z"),
    "gif_quantized": (_round_trip("gif", 16), None),
    "webp_roundtrip": (_round_trip("webp"), _duck_pixels()),
    "jpeg_roundtrip": (_round_trip("jpeg"), None),
    "transform": (_transformed, f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({oracles.TRANSFORMED}) z"),
    "format_names": (
        _formats,
        "SELECT event_id, coalesce(list_extract(['png', 'jpeg', 'bmp', 'gif', 'tiff', 'webp', 'avif', 'heif'], CASE WHEN event_id % 10 BETWEEN 1 AND 8 THEN event_id % 10 END), 'unknown') AS name, coalesce(list_extract(['.png', '.jpg', '.bmp', '.gif', '.tiff', '.webp', '.avif', '.heic'], CASE WHEN event_id % 10 BETWEEN 1 AND 8 THEN event_id % 10 END), '') AS extension FROM events",
    ),
    "decode_cost": (_read_costs, _read_costs_sql()),
    "admission": (_admitted, "SELECT o_orderkey, CASE WHEN (CAST(floor(o_totalprice) AS BIGINT) + o_custkey * 7) * 850 > 120000000 THEN 'reject' ELSE 'admit' END AS decision FROM orders"),
    "considered": (_reasons, f"{_space_sql()} SELECT request, {_REASON_SQL} AS reason, count(*) AS n FROM s GROUP BY ALL"),
    "select_ladder": (_chosen("ladder"), f"{_space_sql()} {_SELECTED} (SELECT *, row_number() OVER (PARTITION BY request ORDER BY candidate, variant) AS n FROM s WHERE db >= 36 AND total_us <= 150000 AND format = 'webp') q WHERE n = 1"),
    "select_independent": (_chosen("independent"), f"{_space_sql()} {_SELECTED} {_INDEPENDENT_SQL}"),
    "decode_region_scaled": (_scaled, f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({_region_sql()}) z"),
    "sniff": (_sniffed, f"SELECT f AS format, count(*) AS n FROM {_IDS} CROSS JOIN (VALUES ('png'), ('bmp'), ('tiff')) v(f) GROUP BY f"),
    "probe_all": (_probed, f"SELECT image_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, f AS format, CAST(4 AS BIGINT) AS channels, true AS has_alpha FROM {_IDS} CROSS JOIN (VALUES ('png'), ('bmp')) v(f)"),
    "crc32": (_crc, _crc_sql()),
    "adler32": (_adler, _adler_sql()),
    "hist_tumbling": (_histogram(None), f"SELECT date_trunc('hour', ts) AS start, {_BIN} AS bin, count(*) AS n FROM events GROUP BY 1, 2"),
    "hist_sliding": (
        _histogram("30 minutes"),
        f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, {_BIN} AS bin, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    ),
    "metadata": (_meta, "SELECT event_id, 'x' AS kind, '7' AS extra, false AS has_user, CAST(2 AS BIGINT) AS n FROM events"),
    "wrap_fixed": (_wrapped, None),
    "palette": (lambda s, d: analysis.palette(pixels(s, d), 5), None),
    "dominant_color": (lambda s, d: analysis.dominant_color(pixels(s, d)), None),
    "remove_background": (lambda s, d: analysis.remove_background(pixels(s, d), 8, 8, 90), None),
    "plan_fused_vs_eager": (spark_query(_chain), _chain_sql()),
    "plan_tone": (spark_query(_planned), f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({_eager(fixture('duck')).sql}) q"),
    "plan_resize": (spark_query(lambda p: Plan(8, 8).resize(12, 3).apply(p)), f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({oracles.HAND['resize_auto']}) q"),
    "plan_resize_with": (spark_query(lambda p: Plan(8, 8).resize(5, 5, "box").apply(p)), f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({oracles.HAND['resize_box_5']}) q"),
    "plan_fit": (spark_query(lambda p: Plan(8, 8, background=(1, 2, 3, 255)).crop(0, 0, 8, 5).fit(6, 6, "pad").apply(p)), f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({oracles.HAND['fit_pad']}) q"),
    "plan_fit_with": (spark_query(lambda p: Plan(8, 8).crop(0, 0, 8, 5).fit(4, 4, "cover", "se").apply(p)), f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({oracles.HAND['gravity_se']}) q"),
    "plan_fields": (_resolutions, _RESOLUTIONS),
    "exif": (_exif, "SELECT event_id, event_id % 3 > 0 AS tagged, CASE WHEN event_id % 3 > 0 THEN CAST(4 AS BIGINT) END AS bytes FROM events"),
    "encode_cost": (_encode_cost, _encode_cost_sql()),
    **{f"select_{o}": (_select(o), _select_sql(o)) for o in cost.OBJECTIVES},
}


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _SPECS.items() if v[1]}
