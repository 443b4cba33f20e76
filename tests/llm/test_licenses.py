"""Licence matches against a brute-force search over all windows."""

import random
import re

import pyarrow as pa

from pixelmill.llm.licenses import TEMPLATES, Scanner


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return [tuple(w[i : i + 2]) for i in range(len(w) - 1)]


def best_dice(text, template):
    """The largest Dice of any window of a text."""
    g, own, top = grams(text), set(grams(template)), 0.0
    for a in range(len(g)):
        seen, both = set(), 0
        for x in g[a:]:
            both += x not in seen and x in own
            seen.add(x)
            top = max(top, 2 * both / (len(seen) + len(own)))
    return top


def scan(text, templates, threshold=0.8):
    return Scanner(templates, threshold).found(pa.array([text]))[0]


def test_a_run_of_words_inside_a_notice():
    name, notice = next(t for t in TEMPLATES if t[0] == "MIT" and len(t[1]) > 200)  # the first paragraph
    for n in (1, 5, 9, 20):
        text = "before it " + notice.replace("and/or sell", " ".join(f"extra{i}" for i in range(n)) + " and/or sell") + " behind it"
        (got,) = scan(text, [(name, notice)])
        assert got["dice"] == round(best_dice(text, notice), 4)
        assert text[got["start"] : got["end"]].startswith("Permission") and text[: got["end"]].endswith("Software")
    (got,) = scan(notice.replace("and/or sell", "na " * 500 + "and/or sell"), [(name, notice)])
    assert got["dice"] > 0.95


def test_the_best_window_is_found():
    rng = random.Random(4)
    words = "a b c d e f g h".split()
    for _ in range(400):
        template = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 14)))
        text = " ".join(rng.choice([*words, "x", "y", template]) for _ in range(rng.randrange(1, 30)))
        threshold = rng.choice((0.6, 0.8, 0.95))
        got, want = scan(text, [("T", template)], threshold), best_dice(text, template)
        assert (max(x["dice"] for x in got) == round(want, 4)) if want >= threshold else got == []
        assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:], strict=False))


def whole(name):
    return max((t[1] for t in TEMPLATES if t[0] == name), key=len)


def test_whole_licences_and_headers_get_their_own_names():
    scanner, rng = Scanner(TEMPLATES, 0.8), random.Random(2)
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "Unlicense"):
        words = whole(name).split()
        edited = list(words)
        for _ in range(len(words) // 60 + 1):
            edited[rng.randrange(len(words))] = "changed"
        for text in (words, edited):
            got = scanner.found(pa.array(["Copyright 2020 Somebody. " + " ".join(text)]))[0]
            assert [x["license"] for x in got] == [name] and got[0]["dice"] > 0.9, (name, got)
    header = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
    for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
        for thing in ("program", "library"):
            text = header.format(thing, kind, version)
            assert [x["license"] for x in scanner.found(pa.array([text]))[0]] == [name + "-or-later"]
            text = text.replace("either ", "").replace(", or (at your option) any later version", "")
            assert [x["license"] for x in scanner.found(pa.array([text]))[0]] == [name]


def test_many_notices_take_time_in_proportion():
    import time

    scanner, took = Scanner(TEMPLATES, 0.8), {}
    for n in (1000, 8000):
        text = "Licensed under the MIT License. some filler words here today " * n
        began = time.process_time()
        got = scanner.found(pa.array([text]))[0]
        took[n] = time.process_time() - began
        assert len(got) == n and {x["license"] for x in got} == {"MIT"}
    assert took[8000] < 30 * max(0.05, took[1000])
