"""A corpus pipeline of five stages over ``documents``, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of ``docs``.

What all stages do with odd rows: an empty table gives an empty result; texts are read whole,
however long; other columns pass through, whatever their names; and whatever is removed goes by
row, not by id, so that rows of null or repeated ids are judged on their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from gridloom.llm.store import documents, materialize, row_hash, scratch


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as a struct ``doc``, with its hash as doc_id, and its text: the operators' tables, free of other columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("doc"), row_hash().alias("key"), F.col("text").alias("text"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"doc.`{c}`") for c in docs.columns]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, each judged where it is read.

    Null and empty texts have no words and go. A null lang is a stratum; a null doc_id takes
    no label. Repeated rows get equal verdicts.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_documents(docs, labels)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id, null ids last, ties by the rows' hashes.

    Rows without words are linked with nothing, and stay. Of rows equal in id and text one stays.
    """
    keyed = _keyed(docs)
    with scratch(spark):
        found = ngram_join.ngram_jaccard_join(keyed.select(F.col("key").alias("doc_id"), "text")).where("n_shingles > 0")
        found = found.groupBy(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).agg(F.count("*").alias("copies"))
        ids = keyed.groupBy("key").agg(F.min("doc.doc_id").alias("id"))
        found = materialize(found.join(ids, "key"), "groups")
        first = materialize(found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).getField("key").alias("first")), "first")
        # rows that go: all but the group's first; rows of which one must be chosen: the first where it stands repeatedly
        judged = found.join(first, "group").select("key", (F.col("key") == F.col("first")).alias("stays"), "copies").where("not stays or copies > 1")
        judged = materialize(judged, "judged", keep=True)
    kept = keyed.join(judged.where("not stays").select("key"), "key", "left_anti")
    repeated = judged.where("stays").select("key")
    once = kept.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(repeated, "key", "left_anti").select(*_columns(docs)).union(once.select(*_columns(docs)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts, and all rows of an empty benchmark, stay."""
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialize(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return keyed.join(leaks, "key", "left_anti").select(*_columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that is cut in part is kept whole.

    Texts without words have no size: they come once for each whole epoch of their source, and
    never in the last, partial one. A null source is a source.
    """
    return mixing.repeated(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their slot and shard, by id, or by text where the id is null; equal keys share a shard. Columns of these two names are replaced."""
    return sharding.placed(docs, sharding.shard_names())


STAGES = [
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages of near duplicates and of latent retrieval have no SQL form. tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return docs
