"""From raw documents to a training mix: toxicity, near-duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last return the columns of
documents; the last returns the documents that the mix takes, with the words it takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm import decontaminate, mixing, pii, simhash, toxicity
from factlattice.llm.common import fresh, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go: those with a score of 0.7 or more. Null and empty texts score as texts without a
    passage; repeated rows are judged each; an empty table stays empty; without labels of both kinds the share of toxic
    labels is every score. Columns besides doc_id and text are passed on as they are."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more) the document of the least id
    stays. Null and empty texts are one group; rows that share a null or other id in different groups stay; rows that
    agree in id and text are one; an empty table stays empty. Other columns are passed on as they are."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out, n_chars follows; documents that were nothing else go. Null and empty texts
    have no words and stay; repeated rows are cut each; an empty table stays empty, and with an empty benchmark all stays.
    Other columns are passed on as they are."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced, n_chars follows. Null and empty texts stay as they are;
    repeated rows are treated alike; an empty table stays empty. Other columns are passed on as they are."""
    return pii.sanitised(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and words taken (repeats counted).

    Null and empty texts have no words and aren't taken; a null source is a source of its own; rows that agree in source,
    id and text share what is taken of them evenly; an empty table gives an empty mix. Where docs has columns of these
    names, the new ones get an underscore more.
    """
    taken = mixing.mixed(docs)
    names = ("size", "source_size", "target", "taken")
    id_, source, key, own = fresh(docs, "_id", "_source", "_key", "_own")
    # Rows that agree in source, id and text can't be told apart: each takes the mean, so that their sum stays near.
    taken = taken.groupBy("text_key", "doc_id", "source").agg(F.round(F.avg("taken")).cast("long").alias("taken"), *(F.first(n).alias(n) for n in names[:3])).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("text_key").alias(key), *(F.col(n).alias(f"_{n}_mix") for n in names))
    held = docs.withColumn(own, mixing.text_key())
    both = held.join(taken, (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)))
    free = fresh(docs, *names)
    return both.select(*docs.columns, *(F.col(f"_{n}_mix").alias(f) for n, f in zip(names, free, strict=True)))


STAGES = [
    ("toxicity", toxicity_stage), ("near_duplicates", near_duplicates_stage), ("decontamination", decontamination_stage),
    ("pii", pii_stage), ("mixture", mixture_stage),
]

#: The toxicity model, the FM-index and XXH64 have no form in DuckDB: tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
