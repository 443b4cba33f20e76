"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases, and so on.  In each round runs of one
symbol become one symbol, then deterministic coin tossing turns symbols into small labels: a symbol's label says at which
lowest bit it differs from its left neighbour and which bit it has there.  A few tosses leave six labels, of which
neighbours differ; a phrase begins where a label is greater than those beside it.  So a boundary depends on a handful of
neighbours only, phrases have 2 to about 10 symbols, and equal substrings get the same phrases in their interiors
wherever they stand.  A phrase's name is a 64-bit hash of its symbols.

The fingerprint of a text holds, for two rounds (phrases of about 10 and 30 bytes), the 32-bit hashes of its distinct
names that are below 2**29, and at least the 24 least ones.  So one name in eight is kept however long a text is, by a
rule that is the same in all texts, and a passage that two texts share shows in both.  Likeness of two fingerprints is the
mean over the rounds of the estimated Jaccard similarity of the name sets: that of the names below 2**29, of the 24 least
ones of both texts if there are fewer, or of all names where both texts have fewer than 24.

A null text counts as empty; empty texts have the empty fingerprint, which is like itself (1) and unlike all others (0).
Repeated rows each give a row, an empty table gives an empty result, columns besides doc_id and text are not read.  A text
is parsed as a whole, in memory of about forty times its bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import textbits as tb
from pixelmill.llm.common import pieces

U = np.uint64
ROUNDS, KEPT, NAMES, BELOW = 3, (1, 2), 24, 1 << 29


def _toss_table() -> np.ndarray:
    """Labels of byte pairs (left << 8 | right): lowest differing bit and the right one's bit there; equal ones differ at 7."""
    left, right = np.divmod(np.arange(1 << 16), 256)
    x = left ^ right
    low = np.bitwise_count((x & -x) - 1).astype(np.int64)
    low[x == 0] = 7
    return (2 * low + ((right >> low) & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on 8-bit labels; the first of a text is tossed against zero."""
    pair = labels.astype(np.uint16)
    pair[1:] |= np.where(first[1:], 0, labels[:-1]).astype(np.uint16) << np.uint16(8)
    return _TOSS[pair]


def _round(sym: np.ndarray, name: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of parsing: names of the phrases and which of them begin a text.

    ``sym`` are the symbols that labels are tossed from, ``name`` their 64-bit names, ``first`` marks texts' first ones.
    """
    start = np.ones(len(sym), bool)
    start[1:] = (sym[1:] != sym[:-1]) | first[1:]
    at = np.flatnonzero(start)
    length = np.diff(at, append=len(sym))
    sym, name, first = sym[at], name[at], first[at]
    long = length > 1
    name = name.copy()
    name[long] = tb.mix(name[long] + length[long].astype(U) * U(0x9E3779B97F4A7C15))
    if sym.dtype == np.uint8:
        labels = _toss(sym, first)
    else:
        before = np.zeros(len(sym), U)
        before[1:] = np.where(first[1:], U(0), sym[:-1])
        x = sym ^ before
        low = np.bitwise_count((x & (~x + U(1))) - U(1)).astype(U)
        low[x == 0] = U(63)
        labels = (U(2) * low + ((sym >> low) & U(1))).astype(np.uint8)
        labels = _toss(labels, first)
    labels = _toss(_toss(labels, first), first)
    head = first.copy()
    head[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    cut = np.flatnonzero(head)
    up, down = tb._powers(len(name) + 1)
    total = np.zeros(len(name) + 1, U)
    np.cumsum(name * up[: len(name)], out=total[1:])
    ends = np.append(cut[1:], len(name))
    out = tb.mix((total[ends] - total[cut]) * down[cut] + (ends - cut).astype(U))
    return out, first[cut]


def phrase_names(column: pa.Array, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each round the names of all texts' phrases in order, and the n + 1 places where texts begin and end."""
    data, offs = tb.raw(column)
    filled = offs[:-1][np.diff(offs) > 0]
    first = np.zeros(len(data), bool)
    first[filled] = True
    texts = np.flatnonzero(np.diff(offs) > 0)
    out = []
    sym, name = data, tb._BYTE[data]
    for _ in range(rounds):
        if len(sym):
            name, first = _round(sym, name, first)
            sym = name
        counts = np.zeros(len(offs) - 1, np.int64)
        begin = np.flatnonzero(first)
        counts[texts] = np.diff(begin, append=len(name))
        out.append((name, np.concatenate([[0], np.cumsum(counts)])))
    return out


def _sample(top: np.ndarray) -> np.ndarray:
    """The distinct ones below the limit, or the least ones if those are too few."""
    low = np.unique(top[top < BELOW])
    return low if len(low) >= NAMES else np.unique(top)[:NAMES]


def prints(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """The fingerprints of texts: for each kept round the 32-bit names that are kept, ascending."""
    column = pa.array(texts, pa.binary()).view(pa.string())
    rounds = phrase_names(column)
    per_round = []
    for r in KEPT:
        name, at = rounds[r]
        top = (tb.mix(name + U(r)) >> U(32)).astype(np.uint32)
        per_round.append([_sample(top[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    return list(zip(*per_round, strict=True))


def as_text(fp: tuple[np.ndarray, ...]) -> str:
    return "|".join(x.astype(">u4").tobytes().hex() for x in fp)


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """0 to 1; 1 for equal fingerprints."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        if not len(x) or not len(y):
            total += len(x) == len(y)
            continue
        p, q = set(x.tolist()), set(y.tolist())
        least = sorted(p | q)
        if len(x) >= NAMES or len(y) >= NAMES:
            least = least[: max(NAMES, bisect_left(least, BELOW))]
        total += sum(v in p and v in q for v in least) / len(least)
    return total / len(a)


def parse_likeness(first: str, second: str) -> float:
    """Likeness of two fingerprints in their text form."""
    back = [tuple(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in t.split("|")) for t in (first, second)]
    return likeness(*back)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                got = prints([(x or "").encode() for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_text(x) for x in got])], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of descending doc_id: part, doc_id, text, tail.

    Rows of a part are its range in order; behind them (tail) comes a copy of the row that follows the range, so every
    row's follower is in its own part.  Ranges are bounded by quantiles; their number follows the bytes of the texts.
    """
    spark = docs.sparkSession
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // (128 << 20)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(1000, 20 * parts))).first()[0] or []
    cuts = np.unique(np.asarray(cuts, np.int64))[::-1]

    def part_of(column: pa.Array) -> np.ndarray:
        ids = column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        part = len(cuts) - np.searchsorted(cuts[::-1], ids, "right")
        return np.where(column.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, part).astype(np.int32)

    def tops(batches):
        for batch in batches:
            column = batch.column("doc_id")
            part = part_of(column)
            used = np.unique(part)
            ids = column.fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([int(ids[part == p].max()) for p in used], pa.int64())], names=["part", "top"])

    top = docs.select("doc_id").mapInArrow(tops, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).orderBy("part").collect()
    first_of = {b["part"]: (a["part"], b["top"]) for a, b in zip([*top[-1:], *top[:-1]], top, strict=True)}

    def deal(batches):
        for batch in batches:
            part = part_of(batch.column("doc_id"))
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            yield _with(batch, part, np.zeros(len(part), bool))
            lead = np.zeros(len(part), bool)
            to = part.copy()
            for p in np.unique(part).tolist():
                before, head = first_of[p]
                here = (part == p) & (ids == head)
                lead |= here
                to[here] = before
            if lead.any():
                yield _with(batch.filter(pa.array(lead)), to[lead], np.ones(int(lead.sum()), bool))

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "doc_id long, text string, part int, tail boolean")
    return dealt.repartition("part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def _with(batch: pa.RecordBatch, part: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(tail)], names=["doc_id", "text", "part", "tail"])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of an edit of it, and how like they and the next document's are.

    The edit puts as many code points of the next document in descending doc_id (after the last, the first) in place of
    the text's last half, or all of it if it is shorter.  Rows of the same doc_id stand in the order of their texts.
    """

    def finish(rows: list[tuple[int | None, int, str]], after: str):
        texts = [r[2] for r in rows]
        following = [*texts[1:], after]
        edits = []
        for text, more in zip(texts, following, strict=True):
            half = len(text) // 2
            edits.append((text[: len(text) - half] + more[:half]).encode("utf-8", "surrogatepass"))
        got = prints([*(t.encode() for t in [*texts, after]), *edits])
        n = len(rows)
        own, edited = got[: n + 1], got[n + 1 :]
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
            pa.array([as_text(x) for x in own[:n]]),
            pa.array([as_text(x) for x in edited]),
            pa.array([likeness(a, b) for a, b in zip(own, edited, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in EDITED.split(", ")])

    def run(batches):
        held: list[tuple[int | None, int, str]] = []
        size, closed = 0, None
        for whole in batches:
            for batch in pieces(whole, "text"):
                for doc_id, text, part, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if tail:
                        if held and held[-1][1] == part and closed != part:
                            yield finish(held, text or "")
                            held, size = [], 0
                        closed = part
                        continue
                    if size > 1 << 20:
                        yield finish(held, text or "")
                        held, size = [], 0
                    held.append((doc_id, part, text or ""))
                    size += len(held[-1][2])

    return _dealt(docs).mapInArrow(run, EDITED)
