"""The registered queries of this subpackage: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.decontam import contaminated
from pixelmill.llm.fingerprints import compare_with_edits
from pixelmill.llm.jaccard import jaccard_components
from pixelmill.llm.licenses import license_summary
from pixelmill.llm.mixing import mix
from pixelmill.llm.pii import find_pii
from pixelmill.llm.secrets import find_secrets
from pixelmill.llm.sharding import shard
from pixelmill.llm.tokens import count_tokens
from pixelmill.llm.toxicity import held_out, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_documents(spark, sf_dir)).drop("found")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(_documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"], x["score"], x["why"]))
    return find_pii(_documents(spark, sf_dir)).withColumn("scores", F.array_join(found, ",")).drop("found")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(_documents(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), k=4, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers  # the vocabulary files are outside the repository

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    got = count_tokens(_documents(spark, sf_dir), tokenizer)
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_chunks", "n_widened")


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    got = shard(_documents(spark, sf_dir), shards)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_pii": op3_pii,
    "op4_license_scans": op4_license_scans,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": op9_sharding,
    "op10_source_mixing": op10_source_mixing,
}
ORACLES: dict[str, str] = {
    "op5_benchmark_decontamination": r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ks AS MATERIALIZED (SELECT *, row_number() OVER () AS item_row, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_row, item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
dr AS MATERIALIZED (SELECT *, row_number() OVER () AS doc_row FROM d),
ds AS (SELECT DISTINCT doc_row, doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM dr, (SELECT DISTINCT k FROM ks), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
n AS (SELECT item_row, count(*) AS n_item FROM bs GROUP BY item_row),
m AS (SELECT doc_row, doc_id, item_row, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_row, doc_id, item_row, item_id)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item_row) WHERE n_shared * 100 >= 80 * n_item
""",
}
