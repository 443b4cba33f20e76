"""Every operator and stage on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import jaccard, stages
from pixelmill.llm import textbits as tb
from pixelmill.llm.decontam import contaminated, with_hits
from pixelmill.llm.fingerprints import compare_with_edits, fingerprints, parse_likeness
from pixelmill.llm.jaccard import Bands, components, jaccard_components
from pixelmill.llm.licenses import find_licenses, license_summary
from pixelmill.llm.mixing import balanced, mix, source_targets
from pixelmill.llm.pii import find_pii
from pixelmill.llm.queries import ORACLES
from pixelmill.llm.secrets import find_secrets
from pixelmill.llm.sharding import shard
from pixelmill.llm.toxicity import BITS, features, held_out, not_toxic, toxicity, train

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    near = []
    for t in texts[:12]:
        w = t.split()
        for _ in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    texts += near + texts[:5] + [texts[0]] * 30 + ["", " \n ", "one", "ONE", "one two three", "é" * 50_000, "x " * 30_000]
    out = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    return [*out, (1000, None, None, None, None), (None, "null id " + texts[1], None, "s1", 1), (1001, None, "en", "s2", 0), out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("n", "id", "sig", "size", "hits", "score", "label", "part", "mark", "rate", "copies", "shard", "k1", "_row", "tail")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * 100 >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50), (1, 95)])
def test_jaccard_components_match_brute_force(docs, rows, k, percent):
    got = Counter(tuple(r) for r in jaccard_components(docs, k, percent).collect())
    assert got == brute_components(rows, k, percent)


def test_bands_let_no_linked_pair_apart():
    for percent in (50, 80, 85, 95):
        bands = Bands(percent, 3000)
        for a in range(1, 400):
            for b in (a, a * 100 // percent):
                assert bands.of(b) - bands.of(a) in (0, 1)
                blocks, _ = bands.blocks(bands.of(a))
                assert blocks == 0 or blocks > (a + b) * (100 - percent) // (100 + percent)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {100, 5} and got[160] == 100 and got[259] == 5


def test_contaminated_matches_brute_force(spark, docs, rows):
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate((3, 4, 5, 6, 12, 30, 90))] + [(50, None), (51, ""), (7, rows[2][1]), (8, "one two three"), (None, rows[4][1])]
    hidden = [(2000 + i, "before " * i + (t or "") + " after" * 9, "en", "s", 1) for i, (_, t) in enumerate(items)]
    every = [tuple(r) for r in docs.select(*[c.split()[0] for c in COLUMNS.split(", ")]).collect()] + hidden
    table = spark.createDataFrame(every, COLUMNS)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def holds(doc, item):
        w = WORD.findall((item or "").translate(LOWER))
        own = shingle_set(item, 5)
        have = WORD.findall((doc or "").translate(LOWER))
        width = min(5, len(w))
        held = {tuple(have[i : i + width]) for i in range(len(have) - width + 1)} if w else set()
        return len(own & held), len(own)

    want = Counter()
    for d in every:
        for item, text in items:
            shared, n = holds(d[1], text)
            if n and shared * 100 >= 80 * n:
                want[d[0], item, n, shared] += 1
    got = Counter(tuple(r)[:4] for r in contaminated(table, bench).collect())
    assert got == want and len(want) > 8
    assert Counter(tuple(r)[:4] for r in contaminated(table, bench, block_bytes=300).collect()) == want
    assert contaminated(table, bench.limit(0)).collect() == []
    con = duckdb.connect()
    for name, kinds, values in (("documents", "doc_id BIGINT, text VARCHAR", [r[:2] for r in every]), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
        con.execute(f"CREATE TABLE {name} ({kinds})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    assert Counter(r[:4] for r in con.execute(ORACLES["op5_benchmark_decontamination"]).fetchall()) == want


def test_mix_meets_its_targets(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sums = Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    names = sorted((x for x in sums if x is not None), key=lambda x: x.encode()) + [None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = 1.5 * sum(sums.values()) - sum(2 * sums[x] for x in capped)
        target = {x: 2.0 * sums[x] if x in capped else rest * weight[x] / sum(weight[y] for y in names if y not in capped) for x in names}
        more = {x for x in names if x not in capped and target[x] > 2 * sums[x]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for g in got:
        assert g.source_size == sums[g.source] and g.target == pytest.approx(target[g.source]) and 0 <= g.taken <= 2 * g.size
        taken[g.source] += g.taken
    for x in names:
        longest = max(size(r[1]) for r in rows if r[3] == x)
        assert abs(taken[x] - target[x]) <= max(0.02 * target[x], 130, longest / 2 if longest > target[x] / 4 else 0)
    assert Counter(map(str, got)) == Counter(map(str, mix(docs.repartition(3)).collect()))


def test_rates_match_a_plain_solver(spark):
    """Bisection on each source's dual over 50 documents, and the optimum's condition: log odds in proportion to sizes."""
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 7, 30, 200, 5000])) for _ in range(50)] + [("d", 0)]
    sizes = spark.createDataFrame(rows, "source string, size long").groupBy("source", "size").agg(F.count("*").alias("n"))
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    for r in balanced(sizes, source_targets(sums, 1.5, 2.0, (5, 2, 1)), 2).collect():
        own = [n for s, n in rows if s == r.source and n]
        if r.lam is None:
            assert r.target in (0, pytest.approx(2 * sum(own)))
            continue
        mean = sum(own) / len(own)
        total = lambda lam: sum(n * 2 / (1 + math.exp(-max(-700, min(700, lam * n / mean)))) for n in own)  # noqa: B023, E731
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if total(mid) < r.target else (lo, mid)
        assert r.mean == pytest.approx(mean) and abs(total(r.lam) - r.target) <= 0.51 and abs(r.residual) <= 0.5
        assert abs(total(lo) - total(r.lam)) <= 1.1
    got = {}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    for r in mix(docs).where("rate > 0 and rate < 2 and size > 0").collect():
        got.setdefault(r.source, []).append(math.log(r.rate / (2 - r.rate)) / r.size)
        assert r.copies in (0, 1, 2)
    assert got and all(max(x) - min(x) <= 1e-6 * max(map(abs, x)) + 1e-9 for x in got.values())


def check_shards(got, rows, shards):
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    return [sum(r.size for r in by.get(i, [])) for i in range(shards)]


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randrange(20, 80)) for _ in range(600)]
    texts += [texts[i] for i in range(60)] * 2
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = shard(spark.createDataFrame(rows, COLUMNS), 4).collect()
    loads = check_shards(got, rows, 4)
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 4
    places = {}
    for r in got:
        places.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(x) > 1 for x in places.values()) <= 2


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "the same text over and over", "en", "s", 1) for i in range(400)] + [(1000 + i, f"another text number {i}", "en", "s", 1) for i in range(200)]
    loads = check_shards(shard(spark.createDataFrame(rows, COLUMNS), 6).collect(), rows, 6)
    assert max(loads) - min(loads) < 0.1 * sum(loads) / 6


def test_odd_rows_are_sharded(docs, rows):
    check_shards(shard(docs, 3).collect(), rows, 3)


def test_fingerprints_of_edits(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[r[0], len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    got = compare_with_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    for r in got:
        assert r.near_edited == pytest.approx(parse_likeness(r.fingerprint, r.edited_fingerprint)) and 0 <= r.near_next <= 1
    by_text = {}
    text_of = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in fingerprints(docs).collect():
        if r.doc_id is not None:
            assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if 300 < r.n_chars < 5000 and r.near_next < 0.5]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


def test_scanners_give_a_row_for_each_row(docs, rows, empty):
    for find in (find_secrets, find_pii, find_licenses, license_summary, fingerprints):
        assert find(docs).count() == len(rows) and find(empty).collect() == []


def test_licenses(spark):
    texts = ["Some words. Released under the MIT License. More é words", "all  RIGHTS-reserved", "This work is licensed under the GNU General Public License, version 3.", "we license nothing here", "é " * 100 + "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in license_summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(5)] == ["MIT", "Proprietary", "GPL-3.0", None, "CC-BY-NC-4.0"]
    for i in (0, 4):
        _, start, end = got[i].spans.rsplit(":", 2)
        assert texts[i][int(start) : int(end)].startswith(("Released", "Licensed"))


def toxic_table(spark, n=500):
    rng = random.Random(11)
    bad, rows, labels = ["scoundrel", "villain", "rotter"], [], []
    for i in range(n):
        w, toxic = sentence(rng, rng.randrange(10, 60)).split(), rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x[2] for x in labels}


def test_toxicity_is_learnt_outside_the_held_out_fold(spark):
    docs, labels, truth = toxic_table(spark)
    got = {r.doc_id: r for r in toxicity(docs, labels).select("*", held_out("doc_id").alias("held")).collect()}
    for i, r in got.items():
        assert r.held == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i, r in got.items() if r.held]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(docs, labels) == train(docs.repartition(7), flipped)


def test_toxicity_on_odd_tables(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 0, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels, keep=["doc_id", "score"])
    assert got.count() == len(rows)
    assert toxicity(empty, labels).collect() == []
    none = toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {1} and all(r.score == 0.5 for r in none)
    assert not_toxic(docs, labels.limit(0)).count() == len(rows)
    kept = not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity(docs, labels).where("predicted = 0").count()


def test_weights_match_a_scalar_ftrl_in_any_partitioning(spark):
    """Plain FTRL-proximal over dictionaries; some doc_ids stand for several texts, of which one is learnt."""
    docs, labels, _ = toxic_table(spark, 60)
    docs = docs.unionByName(docs.where("doc_id % 7 = 3").withColumn("text", F.reverse("text"))).unionByName(docs.where("doc_id = 4"))
    got = train(docs.coalesce(1), labels)
    assert got == train(docs.repartition(7), labels) and len(got) > 10
    text = {}
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        text[r.doc_id] = min(text.get(r.doc_id, (r.h, r.text)), (r.h, r.text))
    folded = {r.doc_id: r.toxic for r in labels.where(~held_out("doc_id")).collect()}
    order = sorted(folded, key=lambda i: int(tb.mix(np.array([i], np.int64).view(np.uint64))[0]))
    z, n, alpha, beta, l1, l2 = {}, {}, 0.5, 1.0, 3.0, 1.0

    def weight(f):
        lasso = 0.0 if f == 1 << BITS else l1
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= lasso else ((1 if v > 0 else -1) * lasso - v) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(4):
        for i in order:
            own = {*features(pa.array([text[i][1]]))[0].tolist(), 1 << BITS}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(map(weight, own)))))) - folded[i]
            for f, w in [(f, weight(f)) for f in own]:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * w
                n[f] = before + g * g
    want = {f: w for f in z if (w := weight(f))}
    assert set(want) == set(got) and all(abs(want[f] - got[f]) < 1e-9 for f in want)


def test_operators_on_no_rows(empty, spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert jaccard_components(empty).collect() == [] == mix(empty).collect()
    assert shard(empty, 4).collect() == [] == compare_with_edits(empty).collect()
    assert with_hits(empty, bench, ["doc_id"]).collect() == []


def test_stages_keep_columns_and_clean_rows(spark, rows, tmp_path):
    docs, labels, truth = toxic_table(spark, 300)
    leak = "secret item words that nobody else would ever write down here today"
    more = spark.createDataFrame([(900, "intro " + leak + " outro", "en", "s", 1), (901, None, None, None, None), (902, "", "en", "s", 0)], COLUMNS)
    docs = docs.unionByName(more).unionByName(docs.where("doc_id = 7"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = stages.drop_toxic(spark, docs, str(tmp_path))
    ids = Counter(r.doc_id for r in clean.collect())
    assert {901, 902} <= set(ids) and sum(truth.get(i, 0) for i in ids) <= 5
    unique = stages.drop_near_duplicates(spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in unique.collect()) == Counter([*range(300), 900, 901, 902])
    kept = stages.drop_contaminated(spark, unique, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("doc_id = 900").count() == 0 and kept.count() == 302
    mixed = stages.mix_sources(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    sharded = stages.to_shards(spark, mixed, str(tmp_path))
    assert sharded.count() == mixed.count()
    empty = docs.limit(0)
    for stage in (stages.drop_toxic, stages.drop_near_duplicates, stages.drop_contaminated, stages.mix_sources, stages.to_shards):
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_near_copies_that_share_buckets_are_linked_in_few_rows(spark, monkeypatch):
    """300 edits of one text, of which some link and many do not: brute force, and rows in proportion to the buckets'."""
    rng = random.Random(17)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(300):
        w = list(base)
        for j in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"edit{i}_{j}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, rows[3][1], "en", "s", 1) for i in range(40)]
    rows += [(2000 + i, " ".join(base[:60]) + " " + sentence(rng, 60), "en", "s", 1) for i in range(60)]
    made = {}

    def spied(df, name, keep=jaccard.written):
        out = keep(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", spied)
    monkeypatch.setattr(jaccard, "CELL", 64)  # several cells for a bucket
    monkeypatch.setattr(jaccard, "_TRIES", 1)
    got = Counter(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, COLUMNS).repartition(3), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)
    assert max(made["candidates"]) < made["buckets"][0] and sum(made["pairs"]) < 10 * len(rows)


def test_a_cell_gives_the_nearest_pairs_of_components():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 200 - d], rng.integers(0, 1 << 63, d, dtype=np.uint64)])) for d in (0, 1, 2, 3, 9, 60)]
    sketches = [jaccard.parities(tb.mix(t)).view(np.uint64) for t in sets]
    n, ids, nothing = np.asarray([len(t) for t in sets]), np.arange(6), [None] * 6
    pairs = lambda comps, gone, tries: sorted((i, int(x)) for i, j in jaccard.near_in_cell(n, ids, np.asarray(comps), sketches, gone, 85, tries) for x in j)
    assert pairs([0, 0, 0, 0, 0, 0], nothing, 1) == []
    assert pairs([0, 0, 0, 0, 4, 5], nothing, 1) == [(4, 0)]
    assert pairs([0, 0, 0, 0, 4, 5], nothing, 3) == [(4, 0), (4, 1), (4, 2)]
    assert pairs([0, 0, 0, 0, 4, 5], [None] * 4 + [[0, 1], None], 1) == [(4, 2)]
    assert pairs([0, 0, 0, 0, 4, 5], [[4], [4], [4], [4], None, None], 9) == []


def test_texts_longer_than_a_step(spark):
    """Texts of more than a megabyte among short ones: what stands at their ends is found, and they compare as a whole."""
    rng = random.Random(23)
    item = "the quick test item that should never stand in any corpus at all"
    tail = f' password = "Zx81kfe9Q2mmPl0" mail last.one@example.org {item} Licensed under the MIT License.'
    long = " ".join(sentence(rng, 1000) for _ in range(190)) + tail
    assert len(long) > 1 << 20
    rows = [(1, long, "en", "s", 1), (2, long + " more", "en", "s", 1), (3, "short text", "en", "s", 1), (4, None, "en", "s", 1), (5, long, "en", "t", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    secrets = {r.doc_id: r for r in find_secrets(docs).collect()}
    at = long.index("password")
    assert f"assign:{at}:{at + 27}" in secrets[1].spans and secrets[1].spans == secrets[5].spans and secrets[3].n_assign == secrets[4].n_assign == 0
    mail = long.index("last.one@")
    assert f"email:{mail}:{mail + 20}" in {r.doc_id: r for r in find_pii(docs).collect()}[2].spans
    assert {r.doc_id: r.license for r in license_summary(docs).collect()} == {1: "MIT", 2: "MIT", 5: "MIT", 3: None, 4: None}
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.containment) for r in contaminated(docs, bench).collect()) == [(i, 7, 1.0) for i in (1, 2, 5)]
    sets = {r[0]: len(shingle_set(r[1], 4)) for r in rows}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, 4, 85).collect()} == {(1, sets[1], 1), (2, sets[2], 1), (5, sets[5], 1), (3, 1, 3), (4, 0, 4)}
    prints = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    assert prints[1] == prints[5] and parse_likeness(prints[1], prints[2]) > 0.99
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    assert scores[1] == scores[5] and len(scores) == 5
    assert {r.doc_id: r.size for r in mix(docs).collect()} == {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    check_shards(shard(docs, 2).collect(), rows, 2)


def test_null_texts_are_not_linked(spark):
    rows = [(None, None, "en", "s", 1)] * 200 + [(i, f"text number {i} " * 5, "en", "s", 1) for i in range(40)]
    got = shard(spark.createDataFrame(rows, COLUMNS), 4).collect()
    check_shards(got, rows, 4)
    spread = Counter(r.shard for r in got if r.doc_id is None)
    assert len(spread) > 1 or max(spread.values()) < 200


def test_equal_rows_are_mixed_together(spark, tmp_path):
    rows = [(1, "one two three", "en", "a", 1)] * 5 + [(2, "four five", "en", "a", 1), (None, "six seven eight", "en", "b", 1), (None, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    total = Counter()
    for r in mix(docs).collect():
        total[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in stages.mix_sources(spark, docs, str(tmp_path)).collect())
    assert got == Counter({k: n for k, n in total.items() if n})
