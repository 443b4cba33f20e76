"""What the operators share: tables written to cut lineage, Arrow maps over texts, hierarchical prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_local: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Where that is unset and the master is local (tests), a temporary folder; where
    it is unset on a cluster, an error, because a local folder would be missing on the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="pixelmill-"))
    return f"file://{_local[0].name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut, no executor's loss matters.

    Files go when the process ends, or earlier with :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._pixelmill_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_pixelmill_path", None)
        if path:
            _delete(table.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: S112  the JVM may be gone already, or the folder with the cluster
            continue


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch; it returns one batch or yields several."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Places (start, end) of runs of texts that hold about ``limit`` bytes; a longer text is a run of its own."""
    start, held = 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(column):
        yield start, len(column)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` hold about ``limit`` bytes."""
    for start, end in slices(batch.column(column), limit):
        yield batch.slice(start, end - start)


def text_function(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column function of whole texts that sends nothing but the texts to Python.

    ``make`` is called once in a task; what it returns gets about a megabyte of texts at a time.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = make()
        for whole in batches:
            out = [found(whole.slice(a, b - a)) for a, b in slices(whole)]
            yield pa.concat_arrays(out) if out else found(whole)

    return F.arrow_udf(run, kind)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Mark a written table for broadcast if it holds at most ``rows`` rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix_sums(
    df: DataFrame,
    by: Sequence[str],
    coarse: Column,
    order: Sequence[Column],
    spread: Column,
    values: dict[str, Column],
    rows: int,
    part_rows: int = 50_000,
) -> DataFrame:
    """Add, for each entry of ``values``, the sum over the rows that stand before this one within its ``by`` group.

    The order is ``coarse`` (few distinct integers), then a hash bucket of ``spread``, then ``order``, which must be
    total up to rows that are equal.  No task gets a whole group: rows are dealt by (by, coarse, bucket); the number of
    buckets grows with ``rows``, the table's row count; bucket totals are summed in two levels and joined back on the
    same keys.
    """
    buckets = max(32, -(-rows // part_rows))
    lot = max(1, round(buckets**0.5))
    keys = [*by, "_coarse", "_bucket"]
    df = df.withColumns({"_coarse": coarse.cast("int"), "_bucket": F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(buckets)).cast("int")})
    df = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    # totals of buckets; where these are many also of lots of them, so no task sums more than about their root in order
    totals = df.groupBy(*keys).agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values)).withColumn("_lot", F.floor(F.col("_bucket") / lot).cast("int"))
    running = lambda w, name, k: F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{k}")
    if buckets <= 1024:
        offsets = totals.select(*keys, *(running(Window.partitionBy(*by).orderBy("_coarse", "_bucket"), f"_t_{k}", k) for k in values))
    else:
        lots = totals.groupBy(*by, "_coarse", "_lot").agg(*(F.sum(f"_t_{k}").alias(f"_l_{k}") for k in values))
        outer = lots.select(*by, "_coarse", "_lot", *(running(Window.partitionBy(*by).orderBy("_coarse", "_lot"), f"_l_{k}", k) for k in values))
        within = totals.select(*keys, "_lot", *(running(Window.partitionBy(*by, "_coarse", "_lot").orderBy("_bucket"), f"_t_{k}", k) for k in values))
        offsets = _joined(within, outer, [*by, "_coarse", "_lot"], "_y_", {f"_o_{k}": "_x_" for k in values})
        offsets = offsets.select(*keys, *((F.col(f"_o_{k}") + F.col(f"_x__o_{k}")).alias(f"_o_{k}") for k in values))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_p_{k}": F.coalesce(F.sum(f"_v_{k}").over(inner), F.lit(0)) for k in values})
    joined = _joined(df, offsets, keys, "_k_", {})
    return joined.withColumns({k: F.col(f"_p_{k}") + F.col(f"_o_{k}") for k in values}).drop(*keys[len(by) :], *(f"_{x}_{k}" for k in values for x in "vpo"))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], mark: str, renamed: dict[str, str]) -> DataFrame:
    """An inner join on keys that may be null; columns in ``renamed`` get that prefix on the right side."""
    right = right.withColumnsRenamed({k: f"{mark}{k}" for k in keys} | {k: f"{x}{k}" for k, x in renamed.items()})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return left.join(right, same).drop(*(f"{mark}{k}" for k in keys))
