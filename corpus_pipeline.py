"""From raw documents to shards of a training mix, in five stages.

Each stage works on all rows that its predecessor kept.  Between stages the rows are written as Parquet to the shared
folder and read again, so a lost executor costs a stage's unfinished tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import stages
from pixelmill.llm.common import written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("n-gram Jaccard join", stages.drop_near_duplicates),
    ("benchmark decontamination", stages.drop_contaminated),
    ("source mixing", stages.mix_sources),
    ("sharding", stages.to_shards),
]

#: The classifier, the components and the rounding have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
