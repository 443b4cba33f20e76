import json
import random

import public_tokenizers
import pytest

from pixelmill.llm.tokens import Encoder, count_spliced, count_tokens, known_rules

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "É", "ß", "'s", "'", "'ll", "1", " ", "\n", "\x1c", "\x85", "ſ", "İ", "x́", "<|endoftext|>", "<|", ".", "--", "µ", "ÿ", "Ÿ", "×", "€", "日本", "\x00", "\x7f", "the", "ing", " th", "thinking", "ΑΣ", "　"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def library(encoder, texts):
    return [len(x) for x in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(8000)] + ["", "x" * 5000, "ab " * 3000]
    assert encoder.counts(texts) == library(encoder, texts)


def test_bounded_cache_keeps_counts_exact():
    small = Encoder(PATH, keep=50)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgé.") for _ in range(rng.randrange(1, 7))) for _ in range(40)) for _ in range(60)]
    assert [small.counts([t])[0] for t in texts] == library(small, texts)


@pytest.mark.parametrize("chunk", [40, 100, 333])
def test_spliced_chunks_give_the_whole_texts_count(encoder, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(PARTS) for _ in range(400)) for _ in range(20)] + ["y" * 900, "word " * 300]
    assert [count_spliced(encoder, t, chunk, 10)[0] for t in texts] == library(encoder, texts)


def test_rows_with_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "the thing", "y"), (3, "", "z"), (3, "", "z"), (4, "a b " * 50, "n")], "doc_id long, text string, n_tokens string")
    got = sorted(count_tokens(docs, PATH, chunk=60, overlap=8).select("n_bytes", "n_tokens", "doc_id").collect(), key=str)
    assert sorted((r[0], r[1]) for r in got) == [(0, 0), (0, 0), (0, 0), (9, 2), (200, 100)]
    assert count_tokens(docs.limit(0), PATH).collect() == []


def test_other_rules_are_left_to_the_library(spark, encoder, tmp_path):
    config = json.loads(encoder.library.to_str())
    assert known_rules(config) and not encoder.plain
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"added_tokens": [{**config["added_tokens"][0], "content": "the thing"}]}):
        assert not known_rules(config | change)
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(config | {"added_tokens": [{**config["added_tokens"][0], "content": "the thing"}]}, f)
    other = Encoder(path)
    texts = ["see the thing here", "the thing" * 9, "the  thing"]
    assert other.plain and other.counts(texts) == library(other, texts) != encoder.counts(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, path, chunk=8, overlap=2).collect()}
    assert [got[i] for i in range(3)] == library(other, texts)
    whole = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert whole.plain and whole.counts(["a  b", ""]) == library(whole, ["a  b", ""])
