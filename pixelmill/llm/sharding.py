"""Sharding by balanced label propagation, in DataFrame functions only.

Documents are linked when their texts are equal.  Links are not listed: a group of equal texts is a hub that each member
is linked to.  Members move in units, a group's rows dealt by a hash into a number of units that grows with the table,
so that a group may fill several shards and no task ever holds a whole group.  A unit starts with a hashed label.  In
each round a group looks for the label that holds most of it among those with room, and the units whose own label holds
less ask to move there; each shard admits units by hash, as many as its quota has room for.

Afterwards sizes are made even: overfull shards release documents, unlinked ones first and the shortest first, and
these fill the gaps of the others, both by prefix sums (see :func:`pixelmill.llm.common.prefix_sums`).  So sizes differ
by about one short document.  Slots are ranks within a shard, made the same way.

Sizes are UTF-8 bytes plus 8; a null text has 8 and is linked with nothing, whatever its doc_id.  Rows with the same doc_id
are separate rows, empty texts are equal ones.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import forget, prefix_sums, written

#: Bytes that a row takes besides its text.
OVERHEAD = 8
_KEY = ["k1", "k2"]


def _pick(values: list[float], index: Column) -> Column:
    """values[index] for a short list: one number for each shard."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), index + 1)


def _interval(edges: list[float], at: Column) -> Column:
    """The first i with at < edges[i], the last one if there is none."""
    out = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        out = F.when(at < edges[i], i).otherwise(out)
    return out


def _loads(df: DataFrame, label: str, size: str, shards: int) -> list[float]:
    """Bytes of each shard; as many numbers as there are shards."""
    out = [0.0] * shards
    for row in df.groupBy(label).agg(F.sum(size).alias("n")).collect():
        out[row[0]] = float(row[1] or 0)
    return out


def propagate(units: DataFrame, quota: float, shards: int, rounds: int = 3) -> DataFrame:
    """Labels of units (k1, k2, salt, n, bytes) after some rounds; a shard admits linked rows up to ``quota`` bytes.

    Unlinked rows are not counted: they leave a shard that is overfull when sizes are made even.
    """
    units = written(units.withColumn("label", F.pmod(F.xxhash64(*_KEY, "salt"), F.lit(shards)).cast("int")), "shard-units")
    for step in range(rounds):
        own = _loads(units, "label", "bytes", shards)
        room = [max(0.0, quota - x) for x in own]
        if not sum(own):
            break
        held = units.groupBy(*_KEY, "label").agg(F.sum("bytes").alias("held"))
        # A whole group goes where it fits; one that fits nowhere takes the roomiest label, ties by held bytes and label.
        score = F.when(_pick(room, F.col("label")) > 0.005 * quota, F.col("held") * F.lit(1.0)).otherwise(F.lit(-1.0))
        best = held.groupBy(*_KEY).agg(F.max(F.struct(score.alias("score"), (-F.col("label")).alias("order"), "held", "label")).alias("best"))
        asked = units.join(best, _KEY).join(held.withColumnRenamed("held", "own"), [*_KEY, "label"])
        wants = (F.col("best.score") > 0) & (F.col("best.label") != F.col("label")) & (F.col("best.held") >= F.col("own"))
        asked = written(asked.select(*_KEY, "salt", "n", "bytes", "label", F.when(wants, F.col("best.label")).alias("to")), "shard-asked")
        demand = _loads(asked.where("to is not null"), "to", "bytes", shards)
        if not sum(demand):
            forget(asked)
            break
        part = [min(1.0, r / d) if d else 0.0 for r, d in zip(room, demand, strict=True)]
        draw = F.pmod(F.xxhash64(*_KEY, "salt", F.lit(step)), F.lit(1 << 20)) / float(1 << 20)
        moved = asked.withColumn("label", F.when(F.col("to").isNotNull() & (draw < _pick(part, F.col("to"))), F.col("to")).otherwise(F.col("label"))).drop("to")
        before, units = units, written(moved, "shard-units")
        forget(before, asked)
    return units


def _evened(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Move short, unlinked documents from overfull shards to the others; returns a written table."""
    loads = _loads(rows, "shard", "size", shards)
    ideal = sum(loads) / shards
    excess = [x - ideal for x in loads]
    octave = F.floor(F.log2(F.col("size")) * 8)
    order = [F.col("linked"), F.col("size"), F.col("mark"), F.col("doc_id")]
    placed = prefix_sums(rows, ["shard"], F.when(F.col("linked"), 1000).otherwise(0) + octave, order, F.col("mark"), {"_before": F.col("size")}, count)
    goes = F.col("_before") + F.col("size") / 2 <= _pick([max(0.0, x) for x in excess], F.col("shard"))
    placed = written(placed.select(*rows.columns, goes.alias("_goes")), "shard-released")
    pool = placed.where("_goes")
    amount = float(pool.agg(F.sum("size")).first()[0] or 0)
    if not amount:
        return placed.drop("_goes")
    edges, total = [], 0.0
    for x in excess:
        total += max(0.0, -x)
        edges.append(total)
    scale = total / amount
    pooled = prefix_sums(pool.withColumn("_all", F.lit(0)), ["_all"], -octave, [F.col("size").desc(), F.col("mark"), F.col("doc_id")], F.col("mark"), {"_before": F.col("size")}, count)
    filled = pooled.withColumn("shard", _interval(edges, (F.col("_before") + F.col("size") / 2) * scale).cast("int"))
    out = written(placed.where("not _goes").drop("_goes").unionByName(filled.select(*rows.columns)), "shard-rows")
    forget(placed)
    return out


def shard(docs: DataFrame, shards: int = 24, rounds: int = 3, evenings: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for every row of ``docs`` (doc_id, text).

    Equal texts share a shard as far as the quota of equal bytes lets them.
    """
    text = F.col("text")
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("k1"),  # null texts have no key and so no link
        F.when(text.isNotNull(), F.xxhash64(F.lit(11), text)).alias("k2"),
        F.xxhash64("doc_id", text).alias("mark"),
    )
    base = written(base, "shard-base")
    count = base.count()
    salts = max(32, -(-count // 2_000_000))
    base = base.withColumn("salt", F.pmod(F.xxhash64("mark", F.lit(3)), F.lit(salts)).cast("int"))
    units = base.groupBy(*_KEY, "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = units.groupBy(*_KEY).agg(F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    linked = written(units.join(groups, _KEY), "shard-linked")
    hashed = F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(shards)).cast("int")
    quota = float(base.agg(F.sum("size")).first()[0] or 0) / shards
    labels = propagate(linked, quota, shards, rounds)
    rows = base.join(labels.select(*_KEY, "salt", "label"), [*_KEY, "salt"], "left")
    rows = written(
        rows.select("doc_id", "size", "text_crc32", "mark", F.col("label").isNotNull().alias("linked"), F.coalesce("label", hashed).alias("shard")), "shard-rows"
    )
    forget(linked)
    for _ in range(evenings):
        rows = _evened(rows, count, shards)
    slots = prefix_sums(rows, ["shard"], F.lit(0), [F.col("mark"), F.col("doc_id"), F.col("size")], F.col("mark"), {"slot": F.lit(1)}, count)
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
