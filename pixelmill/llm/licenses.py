"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Text is normalised to lower-cased runs of letters, digits and bytes beyond ASCII.  For each template of m distinct
bigrams, the places where its own bigrams stand are its hits.  A window of s distinct bigrams can reach a Dice
coefficient of t only if it has at least m t / (2 - t) distinct hits, s <= m (2 - t) / t and at most 2 m (1 - t) / t
distinct bigrams that are not the template's.  So a template is dropped from a document with fewer hits, and its hits are
split where more foreign bigrams stand between two of them; neither loses a window.  Every hit that is left is tried as a
left end with every right end that the bound on s allows: the best Dice counts, and the longest window where it is
equal.  Matches of at least ``threshold`` are kept, the best one where matches overlap, unless another that overlaps it
has at least twice as many bigrams in common with its own template (a whole licence goes before a line inside it).

Templates are one-line mentions, the GNU header notices, opening paragraphs where they belong to one licence alone, and
the whole texts in ``licences``.  AGPL-3.0 is made of GPL-3.0's text, see ``_affero``.  Null and empty texts match nothing;
repeated rows each give a row; an empty table gives an empty result; columns besides doc_id and text are not read.  Of
matches with one Dice the longer goes first, then the one that begins first, then the name that sorts first.  A template
of fewer than two words is refused.
"""

from __future__ import annotations

import heapq
import re
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import textbits as tb
from pixelmill.llm.common import arrow_map, pieces
from pixelmill.llm.toxicity import _SEP

U = np.uint64
FOUND = "array<struct<license:string,start:long,end:long,dice:double>>"
_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())]))
_BITS = 20

# Public licence notices by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
]

#: SPDX name, the GNU licence's word and its version.
_GNU = [("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]
_WHOLE = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]


def _headers() -> list[tuple[str, str]]:
    """The header notices of the GNU licences, for one version alone and with later ones, of programs and libraries."""
    out = []
    for name, kind, version in _GNU:
        for thing in ("program", "library"):
            for suffix, which in (("", f"version {version} of the License"), ("-or-later", f"either version {version} of the License, or (at your option) any later version")):
                body = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, {which}. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
                out.append((name + suffix, body))
    return out


def _affero(gpl: str) -> str:
    """GPL-3.0's text under the name of AGPL-3.0 and with its section 13; the preamble stays GPL-3.0's."""
    head, rest = gpl.split("  13. Use with the GNU Affero General Public License.")
    tail = rest[rest.index("  14. Revised Versions of this License.") :]
    named = [re.sub(r"GNU(\s+)(General Public|GENERAL PUBLIC)", r"GNU Affero\1\2", x) for x in (head, tail)]
    return named[0] + _SECTION_13 + named[1]


_SECTION_13 = """13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently
offer all users interacting with it remotely through a computer network (if your version supports such interaction) an
opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a
network server at no charge, through some standard or customary means of facilitating copying of software. This
Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public
License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work
licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work.
The terms of this License will continue to apply to the part which is the covered work, but the work with which it is
combined will remain governed by version 3 of the GNU General Public License.
"""


def _texts() -> list[tuple[str, str]]:
    """The whole licence texts."""
    folder = resources.files("pixelmill.llm") / "licences"
    out = [(name, (folder / f"{name}.txt").read_text("utf-8")) for name in _WHOLE]
    return [*out, ("AGPL-3.0", _affero(dict(out)["GPL-3.0"]))]


TEMPLATES += [*_headers(), *_texts()]


class Scanner:
    """Templates as sets of bigram hashes."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.names, self.threshold = [t[0] for t in templates], threshold
        h, _, _, upto = tb.words(*tb.raw(pa.array([t[1] for t in templates])), _SEP)
        if (np.diff(upto) < 2).any():
            raise ValueError("a template has fewer than two words")
        sets = [np.unique(x) for x in tb.shingles(h, upto, 2)]
        self.sizes = np.array([len(x) for x in sets])
        self.least = self.sizes * threshold / (2 - threshold) - 1e-9
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        self.foreign = np.floor(2 * self.sizes * (1 - threshold) / threshold + 1e-9).astype(np.int64)
        self.known = np.unique(np.concatenate(sets))
        self.member = np.stack([np.isin(self.known, x, assume_unique=True) for x in sets])
        gram, self.owner = np.nonzero(self.member.T)
        self.upto = np.searchsorted(gram, np.arange(len(self.known) + 1))
        self.probe = np.zeros(1 << _BITS, bool)
        self.probe[(self.known >> U(64 - _BITS)).astype(np.int64)] = True

    def found(self, column: pa.Array) -> list[list[dict]]:
        data, offs = tb.raw(column)
        h, s, e, upto = tb.words(data, offs, _SEP)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        grams = tb.windows(h, 2)
        at = np.flatnonzero(self.probe[(grams >> U(64 - _BITS)).astype(np.int64)])
        at = at[np.isin(grams[at], self.known)]
        doc = np.searchsorted(upto, at, "right") - 1
        inside = at + 1 < upto[doc + 1]
        at, doc = at[inside], doc[inside]
        if not len(at):
            return out
        which = np.searchsorted(self.known, grams[at])
        for d, templates in self._possible(doc, which):
            lo, hi = np.searchsorted(doc, (d, d + 1))
            base = int(upto[d])
            best = self._matches(grams[base : int(upto[d + 1]) - 1], at[lo:hi] - base, which[lo:hi], templates)
            if not best:
                continue
            points = np.cumsum((data[offs[d] : offs[d + 1]] & 0xC0) != 0x80)  # code points up to each byte
            for start, end, dice, name in best:
                a, b = int(s[base + start] - offs[d]), int(e[base + end + 1] - offs[d])
                out[d].append({"license": name, "start": int(points[a] - 1), "end": int(points[b - 1]), "dice": round(dice, 4)})
        return out

    def _possible(self, doc: np.ndarray, which: np.ndarray) -> list[tuple[int, list[int]]]:
        """Documents with the templates of which they have enough distinct bigrams."""
        d, g = np.divmod(np.unique(doc * len(self.known) + which), len(self.known))
        n = self.upto[g + 1] - self.upto[g]
        owner = self.owner[np.repeat(self.upto[g] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        pair, count = np.unique(np.repeat(d, n) * len(self.names) + owner, return_counts=True)
        d, t = np.divmod(pair, len(self.names))
        enough = count >= self.least[t]
        out: dict[int, list[int]] = {}
        for x, y in zip(d[enough].tolist(), t[enough].tolist(), strict=True):
            out.setdefault(x, []).append(y)
        return list(out.items())

    def _matches(self, grams: np.ndarray, places: np.ndarray, which: np.ndarray, templates: list[int]) -> list[tuple[int, int, float, str]]:
        """Best windows of a document, first and last bigram included, without overlap."""
        order = np.argsort(grams, kind="stable")
        again = np.flatnonzero(grams[order][1:] == grams[order][:-1])
        before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
        before[order[again + 1]], after[order[again]] = order[again], order[again + 1]
        pieces, rows = [], []
        for t in templates:
            mine = places[self.member[t][which]]
            far = [i for i in np.flatnonzero(np.diff(mine) - 1 > self.foreign[t]).tolist() if len(np.unique(grams[mine[i] + 1 : mine[i + 1]])) > self.foreign[t]]
            for own in np.split(mine, np.asarray(far, np.int64) + 1):
                if len(np.unique(grams[own])) >= self.least[t]:
                    pieces.append((t, own))
                    rows += [(*x, len(pieces) - 1) for x in self._windows(t, own, before, after)]
        if not rows:
            return []
        rows.sort(key=lambda r: r[0])
        reach = max(r[1] - r[0] for r in rows)
        # the greedy choice; what overlaps a kept window from the left is tried again up to where that begins
        start, end, piece = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 4))
        common, dice = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows])
        name = [self.names[pieces[p][0]] for p in piece.tolist()]
        key = lambda i: (-dice[i], start[i] - end[i], start[i], name[i], i)
        heap, alive = [key(i) for i in range(len(rows))], np.ones(len(rows), bool)
        heapq.heapify(heap)
        kept: list[tuple[int, int, float, str]] = []
        # windows stand by their starts and only get shorter, so those that overlap one are in a slice
        around = lambda a, b: slice(*np.searchsorted(start, (a - reach, b + 1)).tolist())
        while heap:
            top = heapq.heappop(heap)
            i = top[-1]
            if not alive[i] or top != key(i):
                continue
            while True:
                near = around(start[i], end[i])
                larger = near.start + np.flatnonzero(alive[near] & (start[near] <= end[i]) & (end[near] >= start[i]) & (common[near] >= 2 * common[i]))
                if not len(larger):
                    break
                i = min(larger.tolist(), key=key)
            kept.append((int(start[i]), int(end[i]), float(dice[i]), name[i]))
            a, b = kept[-1][:2]
            near = around(a, b)
            hit = near.start + np.flatnonzero(alive[near] & (start[near] <= b) & (end[near] >= a))
            alive[hit[start[hit] >= a]] = False
            for j in hit[start[hit] < a].tolist():
                t, own = pieces[piece[j]]
                new = self._longest(t, own[(own >= start[j]) & (own < a)], before)
                if new is None:
                    alive[j] = False
                else:
                    end[j], common[j], dice[j] = new[1:]
                    heapq.heappush(heap, key(j))
        return sorted(kept)

    def _best(self, t: int, own: np.ndarray, fresh: np.ndarray, is_own: np.ndarray) -> tuple[int, int, int, float] | None:
        """The best window from the first of ``own`` on; ``fresh`` are the places of bigrams that have not stood since."""
        fresh = fresh[: self.most[t] + 1]
        have = np.cumsum(is_own[fresh[: self.most[t]]])
        if have[-1] < self.least[t]:
            return None
        dice = 2 * have / (np.arange(1, len(have) + 1) + self.sizes[t])
        top = len(dice) - 1 - int(np.argmax(dice[::-1]))
        if dice[top] < self.threshold:
            return None
        last = own[np.searchsorted(own, fresh[top + 1]) - 1] if top + 1 < len(fresh) else own[-1]
        return int(own[0]), int(last), int(have[top]), float(dice[top])

    def _longest(self, t: int, own: np.ndarray, before: np.ndarray) -> tuple[int, int, int, float] | None:
        """The best window from the first of ``own`` to at most its last."""
        lo, hi = int(own[0]), int(own[-1]) + 1
        is_own = np.zeros(hi - lo, bool)
        is_own[own - lo] = True
        got = self._best(t, own - lo, np.flatnonzero(before[lo:hi] < lo), is_own)
        return got and (got[0] + lo, got[1] + lo, *got[2:])

    def _windows(self, t: int, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, int, float]]:
        """For each left end the best window: start, end, bigrams in common, Dice.

        The places of first occurrences from a left end on are kept sorted; a step to the right takes the first away
        and puts the same bigram's next place in, so a step's cost does not depend on how far windows reach.
        """
        lo, hi = int(own[0]), int(own[-1]) + 1
        is_own = np.zeros(hi - lo, bool)
        is_own[own - lo] = True
        own, out, done = own - lo, [], 0
        fresh = np.flatnonzero(before[lo:hi] < lo)
        begin, nexts = 0, np.minimum(after[lo:hi] - lo, hi - lo).tolist()
        for left in range(hi - lo):
            if is_own[left]:
                got = self._best(t, own[done:], fresh[begin:], is_own)
                done += 1
                if got:
                    out.append((got[0] + lo, got[1] + lo, *got[2:]))
            if nexts[left] < hi - lo:
                k = begin + int(np.searchsorted(fresh[begin:], nexts[left]))
                fresh[begin : k - 1] = fresh[begin + 1 : k]
                fresh[k - 1] = nexts[left]
            else:
                begin += 1
        return out


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id and found (licence, start, end in code points, dice) for every row of ``docs`` (doc_id, text)."""
    chosen, held = templates or TEMPLATES, []

    def run(whole: pa.RecordBatch):
        if not held:
            held.append(Scanner(chosen, threshold))
        for batch in pieces(whole, "text"):
            found = pa.array(held[0].found(batch.column("text")), _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "found"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id long, found {FOUND}")


def license_summary(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_licenses, license (that of the best match, or null), dice of it, and spans as license:start:end."""
    rows = find_licenses(docs, **how)
    best = F.expr("array_sort(found, (a, b) -> case when a.dice != b.dice then int(signum(b.dice - a.dice)) else int(signum(a.start - b.start)) end)[0]")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.when(F.size("found") > 0, best["license"]).alias("license"), F.when(F.size("found") > 0, best["dice"]).alias("dice"), spans.alias("spans"))
