"""N-gram Jaccard join by parity sketches.

Every text becomes a set of 64-bit shingle hashes.  Two sets of sizes a and b with a Jaccard similarity of p percent or
more differ in at most D = (a + b)(100 - p)/(100 + p) elements.  Shingles are XOR-ed into sketches, whose bits are parities;
as each differing element flips at most one place, sketches of two sets differ in at most D places.  That is used twice:

* Pigeonhole.  Sizes are cut into bands; for pairs whose smaller set lies in a band, the hash space is cut into D + 1 + e
  blocks, and a set's block sketch is the XOR of its elements there.  At least 1 + e of a pair's block sketches agree, and
  a set with at most e empty blocks may leave these out.  A set stands in its own band and, as a larger partner, in the one
  below.  No linked pair escapes.
* Filter.  A sketch of the whole set, of at least 2048 bits and about four for each element, refuses pairs whose Hamming
  distance exceeds D.  A longer sketch is folded to the shorter one's length by XOR of its halves.

What passes is verified on the exact sets, read again from the texts.  Equal sets are one node from the start.  Pairs are
tried in rounds, each of which makes rows in proportion to the buckets' rows and none in proportion to their pairs:

* First each node of a bucket is compared with the bucket's leader, the node whose buckets are the largest in sum (the
  original rather than one of its edits).  What links is one component.
* Then nodes of a bucket in different components are compared, in cells of bounded size (:func:`_dealt`).  A cell emits the
  nearest pairs (four) of a node and a component that pass the filter and takes the two for one from there on, so it emits
  fewer than four times as many pairs as it has components.  Where all of a bucket's pairs are links, the bucket is done:
  what passes the filter lies in one component.  Otherwise the bucket comes again without the pairs that failed and may
  try 16 times as many pairs at a time, until none fails.

So a large group of copies costs a few stars, not all its pairs, and no link between components is lost.

Components are found by hooking and pointer jumping in joins; nothing of the corpus goes to the driver.

Null texts and texts without words have an empty set: n_shingles 0, linked with nothing, component_id their own doc_id.
Texts with fewer than ``k`` words are one shingle, the whole sequence.  Repeated rows are equal sets.  An empty table gives
an empty result.  Sets are told apart by 64-bit fingerprints, equal for different ones with a probability of about 2**-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm import textbits as tb
from pixelmill.llm.common import forget, pieces, written

U = np.uint64
_LEAST_BITS = 2048
#: Sketches have four bits for each element up to this many.
_FINE = 1 << 14
#: A signature that more rows of an Arrow batch have is known to be shared.
_COMMON = 16
#: Nearest pairs of a node and a component that a cell gives at first.
_TRIES = 4
#: About as many rows of a bucket are compared in one place.
CELL = 2048
_SET = "doc_id long, n long, id long, sketch array<long>, sigs array<long>, common array<long>"
_MUL = (U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


class Bands:
    """Size bands and their numbers of blocks for a similarity of ``percent``."""

    def __init__(self, percent: int, top: int = 1 << 34):
        self.percent, self.low = percent, [1]
        while self.low[-1] < top:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 100 // percent)))
        self.array = np.asarray(self.low, np.int64)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.array, n, "right")) - 1

    def blocks(self, band: int) -> tuple[int, int]:
        """Number of blocks, and how many empty ones a set may leave out; 0 blocks if only equal sets link."""
        a = self.low[band + 1] - 1
        most = (a + a * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        spare = 1 + (most + 1) // 40
        return (most + 1 + spare, spare) if most else (0, 0)


def block_sketches(t: np.ndarray, mixed: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a sorted set: one for each block of its own band and of the one below."""
    own = bands.of(len(t))
    out = []
    for band in (own, own - 1):
        blocks, spare = bands.blocks(band) if band >= 0 else (0, 0)
        if not blocks:
            continue
        at = ((t >> U(32)) * U(blocks)) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        label = U((band + 1) * int(_MUL[0]) % (1 << 64))
        used = at[first]
        out.append(tb.mix(np.bitwise_xor.reduceat(mixed, first) + (used + U(1)) * _MUL[1] + label))
        if blocks - len(first) > spare:
            empty = np.setdiff1d(np.arange(blocks, dtype=U), used)
            out.append(tb.mix((empty + U(1)) * _MUL[1] + label))
    return np.concatenate(out) if out else np.zeros(0, U)


def token_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, _, _, upto = tb.words(*tb.raw(column))
    return [np.unique(x) for x in tb.shingles(h, upto, k)]


def fingerprint(t: np.ndarray, mixed: np.ndarray) -> int:
    total = (int(mixed.sum(dtype=U)) + len(t) * int(_MUL[2])) % (1 << 64)
    return int(tb.mix(np.array([total], U)).view(np.int64)[0])


def parities(mixed: np.ndarray) -> np.ndarray:
    """The set's sketch: bit i tells whether an odd number of its elements have i as their low bits."""
    size = max(_LEAST_BITS, 1 << max(0, 4 * min(len(mixed), _FINE) - 1).bit_length(), 1 << max(0, len(mixed) - 1).bit_length())
    bits = np.bincount((mixed & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def _listed(parts: list[np.ndarray | None]) -> pa.Array:
    """A list column; None is a null."""
    lens = np.asarray([-1 if x is None else len(x) for x in parts])
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, U), *(x for x in parts if x is not None)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(lens < 0))


def _parted(sigs: list[np.ndarray | None]) -> tuple[list, list]:
    """Signatures of a batch without and with those that many rows have; of these two rows keep theirs among the first."""
    flat = np.concatenate([np.zeros(0, U), *(x for x in sigs if x is not None)])
    bins = (flat & U((1 << 20) - 1)).astype(np.int64)
    full = flat[np.bincount(bins, minlength=1)[bins] > _COMMON] if len(flat) else flat
    values, counts = np.unique(full, return_counts=True)
    values = values[counts > _COMMON]
    if not len(values):
        return sigs, [None if x is None else x[:0] for x in sigs]
    rare, common, met = [], [], np.zeros(len(values), np.int64)
    for x in sigs:
        if x is None:
            rare.append(None)
            common.append(None)
            continue
        at = np.minimum(np.searchsorted(values, x), len(values) - 1)
        known = values[at] == x
        late = known & (met[at] >= 2)
        met[at[known]] += 1
        rare.append(x[~late])
        common.append(x[late])
    return rare, common


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, id, sketch and block signatures; among rows that a task meets only the first of equal sets carries them.

    Signatures that many rows of one batch have are apart, in ``common``, so that no bucket's rows all meet in the stage
    that looks for shared ones.
    """

    def run(batches):
        bands, seen = Bands(percent), set()
        for whole in batches:
            ns, ids, sketches, sigs = [], [], [], []
            if len(seen) > 1 << 18:
                seen.clear()
            for batch in pieces(whole, "text"):
                for t in token_sets(batch.column("text"), k):
                    mixed = tb.mix(t ^ _MUL[2])
                    ns.append(len(t))
                    ids.append(fingerprint(t, mixed) if len(t) else None)
                    fresh = len(t) and ids[-1] not in seen
                    if fresh:
                        seen.add(ids[-1])
                    sketches.append(parities(mixed).view(U) if fresh else None)
                    sigs.append(block_sketches(t, mixed, bands) if fresh else None)
            rare, common = _parted(sigs)
            yield pa.RecordBatch.from_arrays(
                [whole.column("doc_id"), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), _listed(sketches), _listed(rare), _listed(common)],
                names=["doc_id", "n", "id", "sketch", "sigs", "common"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _SET)


def _differ(percent: int, a: Column, b: Column) -> Column:
    return F.floor((a + b) * (100 - percent) / (100 + percent))


def _hamming(a: Column, b: Column) -> Column:
    """Of two sketches of which one is at most twice as long as the other."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    a, b = fold(a), fold(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _fits(percent: int) -> Column:
    size = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return F.when(size, _hamming(F.col("sa"), F.col("sb")) <= _differ(percent, F.col("na"), F.col("nb"))).otherwise(False)


def _informed(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Add sizes, sketches and documents of both sides of pairs (a, b)."""
    for side in "ab":
        named = info.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"), F.col("doc").alias(f"d{side}"))
        pairs = pairs.join(named, side)
    return pairs


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, per_task: int = 500, step: int = 4 << 20) -> DataFrame:
    """Those of the pairs (a, b, da, db) whose exact sets are similar enough.

    Each document's set is made once and sent along the pairs that it is the second of; the first's set is sent once for
    every ``per_task`` partners, so a hot first one is dealt to many tasks.  A doc_id may be null or stand for several
    texts; a set that has not the node's fingerprint is another text's.
    """
    second = pairs.select(F.col("db").alias("doc_id"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("draw"), F.col("b").alias("node"))
    leads = pairs.groupBy("a", "da").agg(F.count("*").alias("partners"))
    parts = F.ceil(F.col("partners") / per_task)
    second = second.join(leads.select(F.col("a").alias("lead"), parts.alias("parts")), "lead")
    second = second.select("doc_id", "lead", F.pmod("draw", "parts").cast("int").alias("part"), "node")
    first = leads.select(F.col("da").alias("doc_id"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), F.lit(None).cast("long").alias("node"))
    # a document's roles stand in lists of bounded length, whatever their number
    roles = first.unionByName(second).groupBy("doc_id", F.expr("part div 256").alias("_lot")).agg(F.collect_list(F.struct("lead", "part", "node")).alias("roles"))
    roles = written(roles.select(F.col("doc_id").alias("_doc"), "roles"), "roles")
    if (roles.agg(F.sum(F.size("roles"))).first()[0] or 0) <= 200_000:
        near = F.broadcast(roles)
    else:
        near = roles
    texts = docs.select("doc_id", "text").join(near, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "roles")

    def sets(batches):
        cols: tuple[list, ...] = ([], [], [], [])
        held = 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, kinds, strict=True)], names=names)

        for whole in batches:
            for batch in pieces(whole, "text"):
                for t, roles_ in zip(token_sets(batch.column("text"), k), batch.column("roles").to_pylist(), strict=True):
                    if not len(t):
                        continue
                    body, own = t.tobytes(), fingerprint(t, tb.mix(t ^ _MUL[2]))
                    for r in roles_:
                        if own != (r["lead"] if r["node"] is None else r["node"]):
                            continue  # another text of the same doc_id
                        for c, v in zip(cols, (r["lead"], r["part"], r["node"], body), strict=True):
                            c.append(v)
                        held += len(body)
                        if held >= step:
                            yield full()
                            cols, held = ([], [], [], []), 0
        if held:
            yield full()

    kinds, names = (pa.int64(), pa.int32(), pa.int64(), pa.binary()), ["lead", "part", "node", "body"]
    sent = texts.mapInArrow(sets, "lead long, part int, node long, body binary")
    sent = sent.repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("node").asc_nulls_first())

    def compare(batches):
        now, held = None, np.zeros(0, U)
        for batch in batches:
            a, b = [], []
            for lead, part, node, body in zip(*map(batch.column, range(4)), strict=True):
                lead, part, node = lead.as_py(), part.as_py(), node.as_py()
                t = np.frombuffer(body.as_buffer(), U)
                if node is None:
                    now, held = (lead, part), t.copy()
                elif (lead, part) == now:
                    both = len(np.intersect1d(held, t, assume_unique=True))
                    if both * 100 >= percent * (len(held) + len(t) - both):
                        a.append(lead)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sent.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that edges (a, b) lead to) for every node of an edge."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v", "label": "lv"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("lv").alias("lv"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "lv").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        after = written(hooked.join(jump, "to").select("node", F.col("label").alias("was"), F.col("further").alias("label")), "labels")
        changed = after.where("was != label").limit(1).count()
        forget(labels)
        labels = after.select("node", "label")
        labels._pixelmill_path = after._pixelmill_path
        if not changed:
            forget(both)
            return labels


def _dealt(members: DataFrame) -> DataFrame:
    """Rows (sig, id, comp) of buckets that hold several components, with the cell (kind, i, j) that each is compared in.

    A bucket of at most ``CELL`` rows is one cell.  In a larger one, rows of its largest component and the rest are cut
    into blocks by hash: a cell is a block of the largest component with a block of the rest, or two blocks of the rest.
    Buckets of equal members are taken once.
    """
    by = members.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(9))).alias("h2"))
    stats = by.groupBy("sig").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    once = stats.where("comps > 1").groupBy("rows", "h1", "h2").agg(F.min(F.struct("sig", "top")).alias("s")).select("s.sig", "rows", "s.top")
    rows = members.join(once, "sig")
    blocks = lambda n: F.greatest(F.ceil(n / CELL), F.lit(1)).cast("int")
    most, rest = blocks(F.col("top.n")), blocks(F.col("rows") - F.col("top.n"))
    x, y = (F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int") for n in (most, rest))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    of_rest = F.concat(each(most, lambda i: cell(1, i, y)), each(rest, lambda j: cell(2, F.least(y, j), F.greatest(y, j))))
    cells = F.when(F.col("rows") <= CELL, F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("comp") == F.col("top.comp"), each(rest, lambda j: cell(1, x, j))).otherwise(of_rest)
    return rows.withColumn("cells", cells).select("sig", "id", "comp", "cells")


def near_in_cell(n: np.ndarray, ids: np.ndarray, comps: np.ndarray, sketches: list[np.ndarray], failed: list, percent: int, tries: int, step: int = 1 << 20):
    """Places (i, j) of rows in different components whose sketches are near enough and that have not failed.

    Rows ascend in ``n``, and so in the length of their sketches.  A pair has a row outside the largest component, so only
    such rows are compared with all.  Of a row and a component the nearest ``tries`` pairs are given; then they are one.
    """
    comps = np.unique(comps, return_inverse=True)[1]
    probes = np.flatnonzero(comps != np.argmax(np.bincount(comps)))
    if not len(probes):
        return
    gone: dict[int, list[int]] = {}
    place = {x: i for i, x in enumerate(ids.tolist())} if any(x is not None and len(x) for x in failed) else {}
    for i, others in enumerate(failed if place else ()):
        for j in (place.get(x) for x in (others if others is not None else ())):
            if j is not None:
                gone.setdefault(i, []).append(j)
                gone.setdefault(j, []).append(i)
    width = np.fromiter(map(len, sketches), np.int64, len(sketches))
    fold = lambda x, m: x if len(x) == m else x[:m] ^ x[m:]
    for w in np.unique(width[probes]).tolist():
        own = probes[width[probes] == w]
        for v in (w // 2, w, 2 * w):
            lo, hi = np.searchsorted(width, (v, v + 1)).tolist()
            lo, hi = max(lo, int(np.searchsorted(n, -(-n[own[0]] * percent // 100)))), min(hi, int(np.searchsorted(n, n[own[-1]] * 100 // percent, "right")))
            if lo >= hi:
                continue
            m = min(v, w)
            table, mine = np.stack([fold(x, m) for x in sketches[lo:hi]]), np.stack([fold(sketches[i], m) for i in own])
            at_once = max(1, step // (m * len(table)))
            for s in range(0, len(own), at_once):
                batch = own[s : s + at_once]
                a, b = max(lo, int(np.searchsorted(n, -(-n[batch[0]] * percent // 100)))), min(hi, int(np.searchsorted(n, n[batch[-1]] * 100 // percent, "right")))
                for c in range(a, b, max(1, step // m)):
                    cols = np.arange(c, min(b, c + max(1, step // m)))
                    far = np.bitwise_count(mine[s : s + at_once, None, :] ^ table[None, cols - lo, :]).sum(2, dtype=np.int64)
                    p, q = n[batch, None], n[None, cols]
                    near = (far <= (p + q) * (100 - percent) // (100 + percent)) & (np.minimum(p, q) * 100 >= np.maximum(p, q) * percent) & (comps[batch, None] != comps[None, cols])
                    for r in np.flatnonzero(near.any(1)).tolist():
                        i, j = int(batch[r]), cols[near[r]]
                        j = j[np.argsort(far[r, j - c], kind="stable")]
                        j = j[comps[j] != comps[i]]
                        if i in gone:
                            j = j[~np.isin(j, gone[i])]
                        if not len(j):
                            continue
                        order = np.argsort(comps[j], kind="stable")
                        met = comps[j][order]
                        first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
                        rank = np.arange(len(met)) - np.repeat(first, np.diff(np.append(first, len(met))))
                        yield i, j[order[rank < tries]]
                        comps[np.isin(comps, met[first])] = comps[i]


def _candidates(members: DataFrame, info: DataFrame, failed: DataFrame, percent: int, tries: int) -> DataFrame:
    """sig, a, b of nodes of a bucket (sig, id, comp) that are to be verified; a is the one of more weight."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            n, ids, comps, weight = (np.concatenate([r[c] for r in held]) for c in range(1, 5))
            sketches, gone = [x for r in held for x in r[5]], [x for r in held for x in r[6]]
            a, b = [], []
            for i, j in near_in_cell(n, ids, comps, sketches, gone, percent, tries):
                heavy = (weight[i] > weight[j]) | ((weight[i] == weight[j]) & (ids[i] > ids[j]))
                a.append(np.where(heavy, ids[i], ids[j]))
                b.append(np.where(heavy, ids[j], ids[i]))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), held[0][0][0])), pa.array(a), pa.array(b)], names=["sig", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            ids, comps, n, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 8))
            ends = np.cumsum(pc.list_value_length(batch.column(8)).to_numpy(zero_copy_only=False))
            sketches = np.split(batch.column(8).flatten().to_numpy(zero_copy_only=False).view(U), ends[:-1])
            gone = batch.column(9).to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = keys[s].tolist()
                if held and held[0][0] != key:
                    yield from flush()
                    held.clear()
                held.append((key, *(x[s:e].copy() for x in (n, ids, comps, weight)), [x.copy() for x in sketches[s:e]], gone[s:e]))
        if held:
            yield from flush()

    lists = failed.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("gone"))
    rows = _dealt(members).join(info.select("id", "n", "weight", "sketch"), "id").join(lists, "id", "left")
    rows = rows.select("sig", F.explode("cells").alias("c"), "id", "comp", "n", "weight", "sketch", "gone").select("sig", "c.kind", "c.i", "c.j", "id", "comp", "n", "weight", "sketch", "gone")
    rows = rows.repartition("sig", "kind", "i", "j").sortWithinPartitions("sig", "kind", "i", "j", "n", "id")
    return rows.mapInArrow(run, "sig long, a long, b long")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links (a, b): components of the components, so least nodes stay least."""
    for side in "ab":
        links = links.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side, "left")
    pairs = links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), F.col("a").alias("x"), F.col("b").alias("y"))
    pairs = written(pairs, "links")
    tops = components(pairs.where("a != b").select("a", "b").distinct())
    new = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = labels.unionByName(new).join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = written(every, "labels")
    forget(pairs, tops, labels)
    return out


def _linked(docs: DataFrame, shared: DataFrame, info: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label of nodes that are linked to others, by rounds over the buckets (sig, id)."""
    leader = shared.join(info.select("id", "weight"), "id").groupBy("sig").agg(F.max(F.struct("weight", "id")).alias("top")).select("sig", F.col("top.id").alias("a"))
    star = shared.join(leader, "sig").where("id != a").select("a", F.col("id").alias("b")).distinct()
    tried = written(_informed(star, info).where(_fits(percent)).select("a", "b", "da", "db"), "tried")
    found = written(verified(docs, tried, k, percent), "found")
    labels = components(found)
    failed = written(tried.select("a", "b").join(found, ["a", "b"], "left_anti"), "failed")
    forget(tried, found)
    members, tries = shared, _TRIES
    while True:
        named = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("label", "id").alias("comp"))
        named = written(named, "named")
        found = written(_candidates(named, info, failed, percent, tries), "candidates")
        forget(named, *([members] if members is not shared else []))
        if not found.limit(1).count():
            forget(found, failed)
            return labels
        pairs = found.select("a", "b").distinct()
        for side in "ab":
            pairs = pairs.join(info.select(F.col("id").alias(side), F.col("doc").alias(f"d{side}")), side)
        pairs = written(pairs, "pairs")
        links = written(verified(docs, pairs, k, percent), "late")
        wrong = written(pairs.select("a", "b").join(links, ["a", "b"], "left_anti"), "wrong")
        if links.limit(1).count():
            labels = _merged(labels, links)
        forget(links, pairs)
        done = not wrong.limit(1).count()
        if not done:
            again = found.join(wrong, ["a", "b"], "left_semi").select("sig").distinct()
            members = written(shared.join(again, "sig", "left_semi"), "again")
            before, failed = failed, written(failed.unionByName(wrong), "failed")
            forget(before)
            tries *= 16
        forget(found, wrong)
        if done:
            forget(failed)
            return labels


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links of ``percent`` or more lead to, the row's own included.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100: linked sets then differ in size by at most a factor of two")
    base = written(sketched(docs, k, percent), "sets")
    by_sig = Window.partitionBy("sig")
    rows = base.where("sigs is not null").select("id", F.explode("sigs").alias("sig"))
    rows = rows.withColumns({"least": F.min("id").over(by_sig), "most": F.max("id").over(by_sig), "rows": F.count("id").over(by_sig)}).where("least != most").select("sig", "id", "rows")
    common = base.where("size(common) > 0").select(F.explode("common").alias("sig"), "id", F.lit(4 * _COMMON).cast("long").alias("rows"))
    shared = written(rows.unionByName(common).groupBy("sig", "id").agg(F.max("rows").alias("rows")), "buckets")
    # a node's weight, about the size of its buckets, only chooses leaders: what is found does not depend on it
    weights = shared.groupBy("id").agg(F.sum("rows").alias("weight"))
    nodes = base.where("sketch is not null").groupBy("id").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    info = written(nodes.join(weights, "id"), "info")
    whole, base = base, written(base.select("doc_id", "n", "id"), "ids")
    forget(whole)
    labels = _linked(docs, shared, info, k, percent)
    forget(shared, info)

    owners = base.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc"))
    linked = owners.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "doc", F.coalesce("label", "id").alias("label"))
    least = linked.where("label != id").groupBy("label").agg(F.min("doc").alias("least"))
    named = linked.join(least, "label", "left").select("id", F.least("doc", "least").alias("part"), "label")
    tops = named.where("label = id").select("label", F.col("part").alias("component_id"))
    final = named.join(tops, "label").select("id", "component_id")
    return base.select("doc_id", "n", "id").join(final, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
