"""A corpus pipeline: language ID, exact dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again for the next one.  All stages but the last
return the columns of documents; the last one adds the domain, the epoch that takes a document and
the tokens taken.  A row is dropped for its own text: rows that share an id, null ids too, don't share decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, table
from shelfcast.llm.exact_dedup import drop_exact_duplicates
from shelfcast.llm.language_id import keep_identified
from shelfcast.llm.mixing import mixed_documents
from shelfcast.llm.near_dup import drop_near_duplicates
from shelfcast.llm.queries import DOMAIN, MAX_EPOCHS, MIX_SEED, SHARE, mixing_weights
from shelfcast.llm.winnowing import drop_contaminated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, and what they connect, the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by epoch, to the target weights of domains, languages and sources."""
    return mixed_documents(docs.withColumn("domain", F.expr(DOMAIN)), SHARE, mixing_weights(), max_epochs=MAX_EPOCHS, seed=MIX_SEED)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
# language ID fits a model, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
