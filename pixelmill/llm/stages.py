"""Pipeline stages: each takes (spark, docs, sf_dir), keeps the columns of ``docs`` and lets its operator's decisions take effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import written
from pixelmill.llm.decontam import with_hits
from pixelmill.llm.jaccard import jaccard_components
from pixelmill.llm.mixing import mix
from pixelmill.llm.sharding import shard
from pixelmill.llm.toxicity import not_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject; it learns from the labels of documents outside the held-out fold.

    Null and empty texts have the score of the bias alone; repeated rows share their fate; a score of one half rejects.
    Without a label, and in an empty table, every row stays.  Texts are scored whole, whatever their length.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return not_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least doc_id.

    A row is told by its doc_id and text, so a doc_id may be null or stand for several texts; a null one stands behind
    the others.  Of rows with equal doc_id and text one stays.  Texts without words stay, those with a null doc_id in
    all their rows.
    """
    mark = F.xxhash64("text", "doc_id")
    groups = jaccard_components(docs.select(mark.alias("doc_id"), "text"), k=5, percent=80)
    groups = groups.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    ids = docs.select(mark.alias("_row"), F.col("doc_id").alias("_id")).distinct()
    rows = written(groups.join(ids, "_row"), "groups")
    first = rows.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"))
    others = written(rows.join(first.select("_first._row"), "_row", "left_anti").select("_row"), "not-leaders")
    kept = docs.withColumn("_row", mark).join(others, "_row", "left_anti").select(*docs.columns)
    return _one_row_each(kept, mark)


def _one_row_each(docs: DataFrame, mark: Column) -> DataFrame:
    """Drop the second and later rows of a doc_id and text where a table repeats them; only those rows are shuffled."""
    named = docs.where(F.col("doc_id").isNotNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    repeated = written(named.groupBy(mark.alias("_row")).count().where("count > 1").select("_row"), "repeated")
    if not repeated.limit(1).count():
        return docs
    marked = docs.withColumn("_row", mark)
    single = marked.join(repeated, "_row", "left_anti").select(*docs.columns)
    several = marked.join(repeated, "_row", "left_semi").select(*docs.columns)
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item.

    Null and empty texts hold nothing and stay, as all rows do if the benchmark is empty; repeated rows share their fate.
    An item that is held to 0.8 of its shingles exactly counts as held.  Texts are searched whole.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hidden = [c for c in docs.columns if c != "hits"]
    if len(hidden) < len(docs.columns):  # a column of that name is the table's own
        found = with_hits(docs.withColumnRenamed("hits", "_own_hits"), benchmark, [*hidden, "_own_hits"])
        return found.where(F.size("hits") == 0).drop("hits").withColumnRenamed("_own_hits", "hits").select(*docs.columns)
    return with_hits(docs, benchmark, docs.columns).where(F.size("hits") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in as many copies as the mix takes of them.

    Copies come back by two hashes of the row, the key of 128 bits that tells rows; rows that are equal in text, source
    and doc_id are told by their order, so together they come in as many copies as the mix takes of all of them.  Null
    texts have no words and the rate of one copy; ties, long texts and empty tables are as in :func:`mix`.
    """
    row = ["text", "source", "doc_id"]
    marks = {"_row": F.xxhash64(*row), "_row2": F.xxhash64(F.lit(17), *row)}
    keys = list(marks)
    marked = docs.withColumns(marks)
    copies = mix(marked, carry=keys).groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_equal"))
    copies = written(copies.where("_copies > 0"), "copies")
    joined = marked.join(copies, keys)
    each = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    if not copies.where("_equal > 1").limit(1).count():
        return joined.select(*docs.columns, each).select(*docs.columns)
    one = joined.where("_equal = 1").select(*docs.columns, each).select(*docs.columns)
    several = joined.where("_equal > 1").dropDuplicates(keys).select(*docs.columns, each).select(*docs.columns)
    return one.unionByName(several)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Null texts have size 8 and are linked with nothing; repeated rows are separate rows with slots of their own, ties are
    broken by hashes; an empty table gives an empty result.
    """
    return shard(docs)
