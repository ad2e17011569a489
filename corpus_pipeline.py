"""The corpus pipeline: language, exact and near duplicates, benchmark passages, mixture.

Each stage takes the documents that the one before it kept. A stage numbers its rows, finds the numbers to drop, writes them to the
shared folder, and takes them off by an anti join: Spark knows the size of that table and only broadcasts it if it is small. So every
row is judged by itself, and rows without an id or with a repeated one are judged like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strom.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from strom.llm.shared import held_out, salted_lookup, with_row_key
from strom.session import configure, cut_lineage


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    gone = cut_lineage(dropped.select(F.col("_row").alias("_dropped")))
    return rows.join(gone, F.col("_row") == F.col("_dropped"), "left_anti").drop("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without ambiguity; null texts and texts without a letter go."""
    model = language_id.train(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))
    return language_id.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts: the longest, then the smallest id; rows without id come last."""
    rows = with_row_key(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, row_column="_row").where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the smallest id: five-word shingles, similarity 0.8 or more."""
    rows = with_row_key(docs)
    found = near_dedup.near_dedup(rows, width=5, percent=80, id_column="_row").select("_row", "component_id")
    found = cut_lineage(found.join(rows.select("_row", "doc_id"), "_row"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = found.groupBy("component_id").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    members = salted_lookup(found.select("_row", "component_id"), first.select("component_id", F.col("_first._row").alias("_stays")), ["component_id"], F.col("_row"), how="inner")
    return _without(rows, members.where("_row <> _stays"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = with_row_key(docs)
    return _without(rows, decontaminate.contamination(rows, items, id_column="_row").where("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with ``mix_copies``, how often each is in it; those it does not draw go."""
    rows = with_row_key(docs)
    drawn = mixing.pareto_mix(rows, row_column="_row").where("copies > 0").select(F.col("_row").alias("_drawn"), F.col("copies").alias("mix_copies"))
    return rows.drop("mix_copies").join(drawn, F.col("_row") == F.col("_drawn")).drop("_row", "_drawn")


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("mixed", mixed)]
# the first stage decides by a trained model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
