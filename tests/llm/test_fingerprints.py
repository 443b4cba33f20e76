"""What fingerprints of long texts show."""

import random

import numpy as np
import pyarrow as pa

from pixelmill.llm import textbits as tb
from pixelmill.llm.fingerprints import KEPT, as_text, likeness, parse_likeness, phrase_names, prints


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def exact(a, b):
    """The mean over the kept rounds of the Jaccard similarity of all phrase names."""
    rounds, total = phrase_names(pa.array([a, b])), 0.0
    for r in KEPT:
        name, at = rounds[r]
        p, q = set(name[: at[1]].tolist()), set(name[at[1] :].tolist())
        total += len(p & q) / len(p | q)
    return total / len(KEPT)


def test_a_shared_passage_shows_in_long_texts():
    rng = random.Random(12)
    for _ in range(10):
        passage = prose(rng, 200)
        a, b = (f"{prose(rng, rng.randrange(20_000))} {passage} {prose(rng, 20_000)}" for _ in range(2))
        for x, y in zip(*prints([a.encode(), b.encode()]), strict=True):
            assert set(x.tolist()) & set(y.tolist())


def test_likeness_of_long_texts_is_near_the_exact_one():
    rng = random.Random(13)
    for share in (0.1, 0.3, 0.5, 0.8):
        same = prose(rng, int(20_000 * share))
        a, b = (same + " " + prose(rng, int(20_000 * (1 - share))) for _ in range(2))
        p, q = prints([a.encode(), b.encode()])
        assert abs(likeness(p, q) - exact(a, b)) < 0.04
        assert likeness(p, q) == parse_likeness(as_text(p), as_text(q))
        short = prints([b[:2000].encode()])[0]
        assert abs(likeness(p, short) - exact(a, b[:2000])) < 0.04


MASK = (1 << 64) - 1


def mixed(x):
    return int(tb.mix(np.array([x & MASK], np.uint64))[0])


def tossed(values, top):
    """2 x (lowest bit in which a value differs from the one before) + its bit there; ``top`` where they are equal."""
    out = []
    for before, now in zip([0, *values], values):
        low = top if before == now else ((before ^ now) & -(before ^ now)).bit_length() - 1
        out.append(2 * low + (now >> low & 1))
    return out


def parsed(symbols, names, top):
    """One round over one text, a symbol at a time."""
    runs = []
    for s, n in zip(symbols, names):
        if runs and runs[-1][0] == s:
            runs[-1][2] += 1
        else:
            runs.append([s, n, 1])
    names = [n if k == 1 else mixed(n + k * 0x9E3779B97F4A7C15) for _, n, k in runs]
    labels = tossed([s for s, _, _ in runs], top)
    for _ in range(2 if top == 7 else 3):
        labels = tossed(labels, 7)
    cuts = [0] + [i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
    phrases = [names[a:b] for a, b in zip(cuts, [*cuts[1:], len(names)])]
    return [mixed(sum(n * pow(tb._BASE, i, 1 << 64) for i, n in enumerate(p)) + len(p)) for p in phrases]


def test_phrases_match_a_plain_parser():
    rng = random.Random(14)
    texts = ["".join(rng.choice("ab cd\n"[: rng.randrange(1, 7)]) * rng.choice((1, 1, 1, 2, 5)) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += [prose(rng, 300), "é" * 40, "x", ""]
    rounds = phrase_names(pa.array(texts))
    for i, text in enumerate(texts):
        symbols = list(text.encode())
        names = [int(tb._BYTE[b]) for b in symbols]
        for r, (name, at) in enumerate(rounds):
            names = parsed(symbols, names, 7 if r == 0 else 63) if symbols else []
            symbols = names
            assert name[at[i] : at[i + 1]].tolist() == names, (text, r)


def test_phrases_do_not_depend_on_where_a_passage_stands():
    rng = random.Random(15)
    passage = prose(rng, 60)
    for _ in range(20):
        a, b = (prose(rng, rng.randrange(1, 40)) + " " + passage + " " + prose(rng, rng.randrange(1, 40)) for _ in range(2))
        for (name, at), inner in zip(phrase_names(pa.array([a, b])), (30, 10, 3)):
            p, q = name[: at[1]].tolist(), name[at[1] :].tolist()
            assert len(set(p) & set(q)) >= inner
