"""The whole pipeline against a brute-force version on a small fixture."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from pixelmill.llm import stages
from tests.llm.test_operators import COLUMNS, WORD, shingle_set

BAD = ["scoundrel", "villain", "rotter"]


def sentence(rng, n):
    return " ".join(rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randrange(60)) for _ in range(n))


def fixture(rng):
    items = [(i, sentence(rng, rng.randrange(8, 30))) for i in range(5)]
    rows, toxic = [], {}
    for i in range(420):
        words = sentence(rng, rng.randrange(20, 90)).split()
        toxic[i] = rng.random() < 0.25
        if toxic[i]:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        elif rows and rng.random() < 0.2 and not toxic[rows[-1][0]]:
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "edited"
        elif rng.random() < 0.1:
            words[3:3] = rng.choice(items)[1].split()
        rows.append((i, " ".join(words), "en", f"s{i % 4}", len(" ".join(words))))
    return rows, toxic, items


def brute(rows, toxic, items):
    kept = [r for r in rows if not toxic[r[0]]]
    sets, gone = {r[0]: shingle_set(r[1], 5) for r in kept}, set()
    label = {i: i for i in sets}
    for _ in sets:  # the least label spreads until nothing changes
        before = dict(label)
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and len(a & b) * 100 >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    gone = {i for i in label if label[i] != i}
    kept = [r for r in kept if r[0] not in gone]
    own = [shingle_set(t, 5) for _, t in items]
    return [r for r in kept if not any(len(o & shingle_set(r[1], 5)) * 100 >= 80 * len(o) for o in own)]


def test_run_matches_brute_force(spark, tmp_path):
    rows, toxic, items = fixture(random.Random(21))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, toxic, items)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(tuple(r) for r in docs.collect()) == sorted(want) and 50 < len(want) < 300
    mixed = stages.mix_sources(spark, docs, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r[0] for r in want} and max(copies.values()) <= 2
    words = {r[0]: len(WORD.findall(r[1])) for r in want}
    assert abs(sum(n * words[i] for i, n in copies.items()) / (1.5 * sum(words.values())) - 1) < 0.02
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in rows}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(text[i].encode()) + 8, zlib.crc32(text[i].encode())) for i in copies.elements())
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_repeated_and_null_doc_ids_lose_no_text(spark, tmp_path):
    rng = random.Random(31)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    near = lambda t: t + " more"
    rows = [(5, a), (7, a), (5, b), (3, b), (None, c), (None, near(c)), (None, c), (9, d), (None, near(d)), (2, near(e)), (2, near(e)), (1, e), (None, ""), (None, ""), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)
    got = Counter((r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    nulls = [k for k in got if k[0] is None and k[1]]
    assert len(nulls) == 1 and nulls[0][1] in (c, near(c)) and got.pop(nulls[0]) == 1
    assert got == {(5, a): 1, (3, b): 1, (9, d): 1, (1, e): 1, (None, ""): 2, (4, None): 1}
