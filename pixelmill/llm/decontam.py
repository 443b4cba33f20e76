"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document holds a test item if at least ``percent`` per cent of the item's distinct ``k``-word shingles are among the
document's.  Items are partitioned by the size of their sets into octaves.  In a partition whose sets have fewer than u
elements, an item's sketch is its floor((1 - t) u) + 1 least MinHash values: more than an item may miss, so at least one
of them is a shingle of every document that holds the item, however long the document.  A document's shingles are looked
up among all sketches; an item whose sketch it hits often enough is a candidate and is verified on the exact sets.

Words are those of ``[^ \\t-\\r]+`` with A-Z lower-cased.  An item of fewer than ``k`` words is one shingle, its whole
sequence.  Null texts and texts without words hold nothing and are held by nothing; empty tables give empty results.
Repeated rows each have their hits, whatever a text's length.  Rows of the same item_id count as different items.

A benchmark of at most ``block_bytes`` of text is broadcast and its sketches are looked up in one pass over the documents
without a shuffle.  A larger one stays a table: the sketches' hashes are joined with the documents' shingle hashes, claims
are counted by document and item, and the exact sets of the claims that are left are compared (:func:`joined_hits`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm import textbits as tb
from pixelmill.llm.common import pieces, text_function, written

U = np.uint64
HITS = "array<struct<item_id:long,n_item:long,n_shared:long>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))
_PROBE_BITS = 22


class Index:
    """Sketches of items for lookup by shingle hash."""

    def __init__(self, items: list[tuple[int | None, str]], k: int, percent: int):
        self.k, self.percent = k, percent
        column = pa.array([x[1] or "" for x in items], pa.string())
        h, _, _, upto = tb.words(*tb.raw(column))
        sizes = np.diff(upto)
        sets = [np.unique(x) for x in tb.shingles(h, upto, k)]
        self.ids, self.sets, self.lengths, self.need = [], [], [], []
        keys, owners = [], []
        for (item, _), own, size in zip(items, sets, sizes.tolist(), strict=True):
            if not len(own):
                continue
            upper = 1 << len(own).bit_length()
            bottom = own[np.argsort(tb.mix(own), kind="stable")][: (100 - percent) * upper // 100 + 1]
            may_miss = len(own) - -(-percent * len(own) // 100)
            owners.append(np.full(len(bottom), len(self.ids)))
            keys.append(bottom)
            self.need.append(max(1, len(bottom) - may_miss))
            self.ids.append(item)
            self.sets.append(own)
            self.lengths.append(min(size, k))
        keys_, owners_ = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, U), (owners, np.int64)))
        order = np.argsort(keys_, kind="stable")
        keys_, self.owners = keys_[order], owners_[order]
        self.keys, self.first = np.unique(keys_, return_index=True)
        self.first = np.append(self.first, len(keys_))
        self.probe = np.zeros(1 << _PROBE_BITS, bool)
        self.probe[(self.keys >> U(64 - _PROBE_BITS)).astype(np.int64)] = True
        self.widths = sorted(set(self.lengths))

    def hits(self, column: pa.Array) -> list[list[dict]]:
        """Items that each text holds."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        h, _, _, upto = tb.words(*tb.raw(column))
        doc = np.repeat(np.arange(len(column)), np.diff(upto))
        found_doc, found_key, by_width = [], [], {}
        for width in self.widths:
            x = by_width[width] = tb.windows(h, width)
            at = np.flatnonzero(self.probe[(x >> U(64 - _PROBE_BITS)).astype(np.int64)])
            at = at[doc[at] == doc[at + width - 1]]
            key = np.searchsorted(self.keys, x[at])
            key[key == len(self.keys)] = 0
            good = self.keys[key] == x[at] if len(at) else np.zeros(0, bool)
            found_doc.append(doc[at[good]])
            found_key.append(key[good])
        if not found_doc:
            return out
        pairs = np.unique(np.concatenate(found_doc) * max(1, len(self.keys)) + np.concatenate(found_key))
        docs, keys = pairs // max(1, len(self.keys)), pairs % max(1, len(self.keys))
        each = self.first[keys + 1] - self.first[keys]
        owner = self.owners[np.repeat(self.first[keys], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        claims, count = np.unique(np.repeat(docs, each) * max(1, len(self.ids)) + owner, return_counts=True)
        held, now = {}, -1
        for claim, hit in zip(claims.tolist(), count.tolist(), strict=True):
            d, item = divmod(claim, len(self.ids))
            if hit < self.need[item]:
                continue
            if d != now:
                held, now = {}, d
            width = self.lengths[item]
            if width not in held:
                held[width] = np.unique(by_width[width][upto[d] : max(upto[d], upto[d + 1] - width + 1)])
            own = self.sets[item]
            place = np.searchsorted(held[width], own)
            place[place == len(held[width])] = 0
            shared = int((held[width][place] == own).sum()) if len(held[width]) else 0
            if shared * 100 >= self.percent * len(own):
                out[d].append({"item_id": self.ids[item], "n_item": len(own), "n_shared": shared})
        return out


def with_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], k: int = 5, percent: int = 80, block_bytes: int = 16 << 20) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` and ``hits``, the items of ``benchmark`` (item_id, text) that its text holds."""
    items = benchmark.select("item_id", "text").where("text is not null")
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > block_bytes:
        return joined_hits(docs, items, keep, k, percent)
    sent = docs.sparkSession.sparkContext.broadcast(sorted(map(tuple, items.collect()), key=str))

    def make():
        index = Index(sent.value, k, percent)
        return lambda texts: pa.array(index.hits(texts), _ARROW)

    found = text_function(make, HITS)(F.col("text"))
    return docs.select(*(F.col(c) for c in keep if c != "hits"), F.when(found.isNull(), F.array().cast(HITS)).otherwise(found).alias("hits"))


def joined_hits(docs: DataFrame, items: DataFrame, keep: list[str], k: int, percent: int, batch: int = 1 << 16) -> DataFrame:
    """What :func:`with_hits` gives, for a benchmark of any size: nothing of it goes to the driver or to every executor.

    Rows of documents are told by two hashes of their text, so equal texts are searched once.
    """
    marks = [F.xxhash64("text"), F.xxhash64(F.lit(13), "text")]
    texts = docs.where("text is not null").select(marks[0].alias("d1"), marks[1].alias("d2"), "text")
    rows = written(items.select("item_id", "text", F.xxhash64("text", "item_id").alias("item")).withColumn("copy", F.row_number().over(Window.partitionBy("item", "item_id", "text").orderBy("item"))), "bench-items")

    def sketch(batches):
        for whole in batches:
            for part in pieces(whole, "text"):
                index = Index([(i, t) for i, t in enumerate(part.column("text").to_pylist())], k, percent)
                own, sizes = np.asarray(index.ids, np.int64), np.asarray([len(x) for x in index.sets], np.int64)
                each, at = index.owners, own[index.owners] if len(own) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(index.keys, np.diff(index.first)).view(np.int64)), part.column("item").take(pa.array(at)), part.column("copy").take(pa.array(at)), pa.array(np.asarray(index.need, np.int64)[each]), pa.array(np.asarray(index.lengths, np.int64)[each]), pa.array(sizes[each])],
                    names=["key", "item", "copy", "need", "width", "n_item"],
                )

    sketches = written(rows.select("item", "copy", "text").mapInArrow(sketch, "key long, item long, copy int, need long, width long, n_item long"), "bench-sketches")
    widths = [r[0] for r in sketches.select("width").distinct().collect()]  # 1 to k

    def shingled(batches):
        for whole in batches:
            for part in pieces(whole, "text"):
                h, _, _, upto = tb.words(*tb.raw(part.column("text")))
                for i in range(part.num_rows):
                    own = h[upto[i] : upto[i + 1]]
                    for w in widths:
                        x = np.unique(tb.windows(own, w)) if len(own) >= w else own[:0]
                        for s in range(0, len(x), batch):
                            y = x[s : s + batch]
                            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(y), part.column(c)[i].as_py())) for c in ("d1", "d2")), pa.array(y.view(np.int64)), pa.array(np.full(len(y), w))], names=["d1", "d2", "key", "width"])

    grams = texts.mapInArrow(shingled, "d1 long, d2 long, key long, width long")
    met = grams.join(sketches, ["key", "width"]).groupBy("d1", "d2", "item", "copy", "key").agg(F.max("need").alias("need"))
    claims = written(met.groupBy("d1", "d2", "item", "copy").agg(F.count("*").alias("hit"), F.max("need").alias("need")).where("hit >= need").select("d1", "d2", "item", "copy"), "bench-claims")
    pairs = claims.join(texts.join(claims.select("d1", "d2").distinct(), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"]), ["d1", "d2"])
    pairs = pairs.join(rows.select("item", "copy", "item_id", F.col("text").alias("wanted")), ["item", "copy"])

    def exact(batches):
        for whole in batches:
            for part in pieces(whole, "text"):
                found = [Index([x], k, percent).hits(part.column("text").slice(i, 1))[0] for i, x in enumerate(zip(part.column("item_id").to_pylist(), part.column("wanted").to_pylist(), strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("d1"), part.column("d2"), pa.array(found, _ARROW)], names=["d1", "d2", "hits"])

    hits = pairs.select("d1", "d2", "text", "item_id", "wanted").mapInArrow(exact, f"d1 long, d2 long, hits {HITS}").where("size(hits) > 0")
    hits = hits.groupBy("d1", "d2").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("_hits"))
    own = docs.select(*(F.col(c) for c in keep if c != "hits"), marks[0].alias("_d1"), marks[1].alias("_d2"), F.col("text").isNotNull().alias("_text"))
    joined = own.join(hits, (F.col("_d1") == F.col("d1")) & (F.col("_d2") == F.col("d2")) & F.col("_text"), "left")
    return joined.select(*(F.col(c) for c in keep if c != "hits"), F.coalesce("_hits", F.array().cast(HITS)).alias("hits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, n_item, n_shared, containment."""
    rows = with_hits(docs, benchmark, ["doc_id"], **how).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    return rows.withColumn("containment", F.col("n_shared") / F.col("n_item"))
