"""Token counts by overlap resynchronisation.

A document of at most ``chunk`` code points is encoded in one piece.  A longer one is cut into chunks that overlap;
each chunk is encoded with offsets, and neighbours are spliced at a *stable common boundary* inside their overlap: a
place where the text has white space, so that no token of either encoding crosses it, and behind which both encodings
list the same token ends up to the next such place.  If an overlap has no such boundary it is widened (doubled) and
encoded again, at last to the end of the text, which is exact by definition.

White space is stable for a tokenizer whose normaliser turns it into one space and whose pre-tokenizer drops it
(``word_bpe_49k.json``): no piece contains any.  For the same reason the encoder may look at each run of non-space
characters by itself; it keeps the library's answer for runs it has met, in a table of bounded size.

A file whose normaliser, pre-tokenizer, model or added tokens are others (:func:`known_rules`) is counted by the library
alone, whole text by whole text, so no assumption about white space or pieces can miscount it.

Nulls and empty texts have no tokens.  Repeated rows each give a row, an empty table gives an empty result, and columns
besides doc_id and text are not read.  Memory is in proportion to a chunk plus the longest run without white space, which
is encoded as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from pixelmill.llm.common import arrow_map, pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int, n_widened int"
#: \s takes \x1c to \x1f for white space, the tokenizer does not.
_RUNS_ODD = re.compile(r"(?:[\x1c-\x1f]|[^\s])+")
#: Anything but ASCII and the letters of Latin-1, which NFC keeps and of which every lower-case form is one character.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


# The rules under which white space parts texts and pieces are cut by _PIECE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def known_rules(config: dict) -> bool:
    """Whether a tokenizers file has the rules that splicing and the merge loop rest on."""
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    model, added = config.get("model") or {}, config.get("added_tokens") or []
    return (
        (config.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and len(cuts) == 2
        and (cuts[0].get("type"), cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ("Split", {"Regex": _PATTERN}, "Removed", True)
        and (cuts[1].get("type"), cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
    )


class Merges:
    """The merges of a byte-level BPE model with word ends, applied to many pieces at once.

    A step merges in every piece the pair of least rank, the leftmost of equal ones, as the library does one by one.
    Ranks come from an open-addressed table of pairs.
    """

    NONE = 1 << 30

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        others = [b for b in range(256) if b not in set(plain)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.shift = 64 - max(12, 2 + len(keys).bit_length())
        self.keys = np.full((1 << (64 - self.shift)) + 64, -1, np.int64)
        self.ranks = np.full(len(self.keys), self.NONE, np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], self.NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            out[todo] = np.where(found == keys[todo], self.ranks[at[todo]], out[todo])
            todo = todo[(found != keys[todo]) & (found >= 0)]
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece; time is quadratic in a piece's length, so pieces should be short."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order, out = np.argsort(lengths, kind="stable"), lengths.copy()
        for i in range(0, len(pieces), 2048):
            part = order[i : i + 2048]
            out[part] -= self._merged([pieces[j] for j in part], lengths[part])
        return out

    def _merged(self, pieces: list[bytes], n: np.ndarray) -> np.ndarray:
        width, w = int(n[-1]), len(pieces)
        raw = np.zeros((w, width), np.uint8)
        raw[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        done, rows = np.zeros(w, np.int64), np.arange(w)
        sym = self.inner[raw]
        sym[rows, n - 1] = self.last[raw[rows, n - 1]]
        if width < 2:
            return done
        col = np.arange(width - 1)
        rank = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(w, -1)
        rank[col >= (n - 1)[:, None]] = self.NONE
        n = n.copy()
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            live = best < self.NONE
            if not live.all():
                rows, sym, rank, n, at, best = rows[live], sym[live], rank[live], n[live], at[live], best[live]
                if not len(rows):
                    return done
            own = np.arange(len(rows))
            done[rows] += 1
            n -= 1
            sym[own, at] = self.made[best]
            later = col >= at[:, None]
            moved = np.where(later, np.concatenate([sym[:, 2:], sym[:, -1:]], 1), sym[:, 1:])
            sym[:, 1:] = moved
            rank = np.where(later, np.concatenate([rank[:, 1:], np.full((len(rows), 1), self.NONE)], 1), rank)
            for p in (at - 1, at):
                ok = np.flatnonzero((p >= 0) & (p < n - 1))
                rank[ok, p[ok]] = self.rank(sym[ok, p[ok]], sym[ok, p[ok] + 1])
            end = np.flatnonzero(at >= n - 1)
            rank[end, at[end].clip(0, width - 2)] = self.NONE


class Encoder:
    """Counts and ends of tokens of texts.

    Text of ASCII and Latin letters is cut into the library's pieces by an equal pattern, and a piece's tokens are
    counted by :class:`Merges`; runs with other characters, and long pieces, go through the library.  Counts are kept in
    two generations of at most ``keep`` entries; when the younger is full it becomes the older and an entry that is met
    again moves back, so frequent ones stay and memory is bounded.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(self.library.to_str())
        self.plain = not known_rules(config)
        self.merges = None if self.plain else Merges(config["model"])
        self.keep, self.young, self.old, self.ends = keep, {}, {}, {}

    def _learn(self, new: set[str]) -> None:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = new.difference(again)
        short = [x for x in new if len(x) <= 40 and "<|" not in x and not _OTHER.search(x)]
        for at in range(0, len(short), 1 << 16):
            part = short[at : at + (1 << 16)]
            self.young.update(zip(part, self.merges.counts([x.encode() for x in part]).tolist(), strict=True))
        for x in new.difference(short):
            self.young[x] = len(self.library.encode(x, add_special_tokens=False))

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens that the library gives for each whole text."""
        if self.plain:
            return [len(x) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = []
        for text in texts:
            if not _OTHER.search(text) and "<|" not in text:
                cut.append(_PIECE.findall(text.lower()))
                continue
            own = []
            for run in _RUNS_ODD.findall(text):
                own += [run] if _OTHER.search(run) or "<|" in run else _PIECE.findall(run.lower())
            cut.append(own)
        new = set().union(*cut).difference(self.young)
        if new:
            if len(self.young) > self.keep:
                new = set().union(*cut)
            self._learn(new)
        known = self.young.__getitem__
        return [sum(map(known, own)) for own in cut]

    def token_ends(self, text: str) -> np.ndarray:
        """The end of each token, in code points, in order."""
        out: list[int] = []
        for m in _RUNS_ODD.finditer(text):
            run, at = m[0], m.start()
            ends = self.ends.get(run)
            if ends is None:
                if len(self.ends) >= self.keep:
                    self.ends.clear()
                got = self.library.encode(run, add_special_tokens=False)
                ends = self.ends[run] = [e for _, e in got.offsets]
            out.extend([at + e for e in ends] if at else ends)
        return np.asarray(out, np.int64)


def _boundary(text: str, lo: int, hi: int, left: np.ndarray, right: np.ndarray) -> int | None:
    """A place p in [lo, hi) with white space at p, another at q > p, and equal token ends in between in both encodings."""
    spaces = [m.start() for m in re.finditer(r"[^\S\x1c-\x1f]", text[lo:hi])]
    for p, q in zip(spaces, spaces[1:], strict=False):
        p, q = p + lo, q + lo
        if q - p > 1:
            a = left[np.searchsorted(left, p, "right") : np.searchsorted(left, q, "right")]
            b = right[np.searchsorted(right, p, "right") : np.searchsorted(right, q, "right")]
            if len(a) and np.array_equal(a, b):
                return p
    return None


def count_spliced(encoder: Encoder, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """Tokens of a long text, the number of chunks and how often an overlap was widened."""
    n, start, total, chunks, widened = len(text), 0, 0, 1, 0
    end = min(n, chunk)
    ends = encoder.token_ends(text[:end])
    while end < n:
        width = min(overlap, end - start)
        while True:
            at = end - width
            to = min(n, at + chunk + width)
            following = encoder.token_ends(text[at:to]) + at
            cut = _boundary(text, at, end, ends, following)
            if cut is not None:
                total += int(np.searchsorted(ends, cut, "right"))
                start, ends = cut, following[np.searchsorted(following, cut, "right") :]
                break
            widened += 1
            if width >= end - start:  # no stable place in the whole chunk: encode it together with what follows
                to = min(n, end + max(chunk, end - start))
                ends = encoder.token_ends(text[start:to]) + start
                break
            width = min(end - start, 2 * width)
        chunks += 1
        end = to
    return total + len(ends), chunks, widened


def count_tokens(docs: DataFrame, tokenizer: str, chunk: int = 65_536, overlap: int = 512) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): UTF-8 bytes, tokens, chunks used and overlaps widened.

    ``tokenizer`` is a path of a tokenizers file that every executor can open; it is read once per worker.
    """

    held: dict[str, Encoder] = {}

    def run(whole: pa.RecordBatch):
        for batch in pieces(whole, "text", 2 << 20):
            yield counted(batch)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "it" not in held:
            held["it"] = Encoder(tokenizer)
        encoder, texts = held["it"], [x or "" for x in batch.column("text").to_pylist()]
        long = [len(x) > chunk and not encoder.plain for x in texts]
        rows = [(n, 1, 0) for n in encoder.counts(["" if y else x for x, y in zip(texts, long, strict=True)])]
        rows = [count_spliced(encoder, x, chunk, overlap) if y else r for x, y, r in zip(texts, long, rows, strict=True)]
        n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
        tokens, chunks, widened = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), n_bytes, pa.array(tokens, pa.int64()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())],
            names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"],
        )

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
