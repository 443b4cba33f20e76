"""Spans that scanners find in texts: their digest columns and the Arrow plumbing that two operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import arrow_map

#: kind, start, end (code points, end exclusive), score, and the name or word that raised it.
Span = tuple[str, int, int, float, str]
SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:double,why:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("why", pa.string())]))


def scan_spans(docs: DataFrame, scan: Callable[[str], list[Span]], base: Sequence[str], by_kind: bool) -> DataFrame:
    """Apply ``scan`` to every whole text.

    Returns doc_id, found (the spans in order), n_<kind> for each base kind, base_sha256 (of the base spans) and spans
    (all spans as kind:start:end, comma-joined).  ``by_kind`` orders by kind and then start, else by start and then kind;
    kinds that are not in ``base`` stand behind those that are.  A null text counts as empty.
    """
    rank = {k: i for i, k in enumerate(base)}

    def order(s: Span) -> tuple:
        k = (rank.get(s[0], len(rank)), s[0])
        return (*k, s[1], s[2]) if by_kind else (s[1], *k, s[2])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sums, joined = [], [], []
        counts: list[list[int]] = [[] for _ in base]
        for text in batch.column("text"):
            own = sorted(scan(text.as_py() or ""), key=order)
            found.append([dict(zip(("kind", "start", "end", "score", "why"), s, strict=True)) for s in own])
            for k, n in zip(base, counts, strict=True):
                n.append(sum(s[0] == k for s in own))
            sums.append(hashlib.sha256(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in own if s[0] in rank).encode()).hexdigest())
            joined.append(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in own))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, _ARROW), *(pa.array(n, pa.int64()) for n in counts), pa.array(sums, pa.string()), pa.array(joined, pa.string())],
            names=["doc_id", "found", *(f"n_{k}" for k in base), "base_sha256", "spans"],
        )

    kinds = ", ".join(f"n_{k} long" for k in base)
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id long, found {SPAN_TYPE}, {kinds}, base_sha256 string, spans string")


def extracts(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row per span with its text: doc_id, kind, start, end, score, why, content."""
    rows = scanned.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    return rows.join(docs.select("doc_id", "text"), "doc_id").withColumn("content", F.expr("substring(text, int(start) + 1, int(end - start))")).drop("text")
