"""The corpus pipeline: raw documents to packed training sequences.

STAGES are applied one after the other; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs:

1. quality: documents that the quality rules reject go;
2. toxicity: documents that the classifier, fitted on labelled rows, calls toxic go;
3. near_dedup: one document of each group of near copies stays, linked by five-word
   shingles at a similarity of 0.8 or more;
4. substring_dedup: words of passages that a document with a smaller id has too go;
5. packing: what is left becomes token pieces in sequences of at most 1,024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.llm import near_dedup, packing, quality_rules, substring_dedup, toxicity
from kiteloom.llm.common import stage, table
from kiteloom.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # length alone is no fault: a long clean document goes on
    return quality_rules.reject(docs, [r for r in quality_rules.RULES if r.name != "many_words"])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.thin(docs, n=5, numerator=80, denominator=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages, of which something is left."""
    return substring_dedup.apply(docs).filter(F.col("text") != "")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", near), ("substring_dedup", substrings), ("packing", pack)]
#: Classification, near-copy components and tokens aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
