"""Exact duplicates: skew-safe combining in three steps, each of which compares full content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.llm.shared import SPACES, salt, salted_lookup
from strom.session import cut_lineage

_SCALE, _NULL_ID = 10**20, 10**19  # a null id counts as one above any 64-bit id


def _number(value: int, digits: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def without_spaces(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for character in SPACES:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 64, row_column: str | None = None) -> DataFrame:
    """One row per document: which document of its class of equal texts stays.

    Texts are equal when identical without ASCII white space; null counts as empty. The longest original text
    stays (code points), then the smallest id. Copies are combined within each input partition, then per salted
    digest, then over the salts; the normalised text is part of the key in every one of these groupings. The
    members then meet the winners by (digest, salt). Two texts under one digest would stop the job by an error.

    Columns: id, keep_id, group_size, kept, text_sha256. Rows that repeat an id share its decision; a null id
    ranks after all others, and where only null ids are in a class, each of its rows is kept. Other columns of
    ``docs`` are not read. An empty table gives an empty result.

    With ``row_column``, a key of each row, that is a column more, and of all rows of a class that rank first just the one with
    the smallest key is kept.
    """
    norm = without_spaces(F.col(text_column))
    # longest first, then smallest id, as one number of fixed width: such buffers stay in the hash aggregate
    length = (F.length(F.coalesce(F.col(text_column), F.lit(""))) + 1).cast("decimal(10,0)") * _number(_SCALE, 21)
    order = (length - F.coalesce(F.col(id_column).cast("decimal(20,0)"), _number(_NULL_ID, 20))).cast("decimal(38,0)")
    rows = docs.select(F.col(id_column).cast("bigint").alias("_id"), norm.alias("_norm"), order.alias("_best")).withColumns(
        {"_digest": F.sha2("_norm", 256), "_salt": salt(F.col("_id"), salts)}
    )
    salted = rows.groupBy("_digest", "_salt", "_norm").agg(F.max("_best").alias("_best"), F.count(F.lit(1)).alias("_n"))
    contents = salted.groupBy("_digest", "_norm").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
    classes = contents.groupBy("_digest").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    scale = _number(_SCALE, 38)
    over = F.col("_best") % scale  # the length is a multiple of the scale, ids reach less than half of it either way
    found = F.when(over > _number(_SCALE // 2, 38), scale - over).otherwise(-over).cast("decimal(38,0)")
    winner = F.when(found != _number(_NULL_ID, 38), found).cast("bigint")
    winners = classes.select(
        "_digest",
        F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts under one digest")).cast("bigint")).otherwise(winner).alias("keep_id"),
        F.col("_n").alias("group_size"), F.col("_best").alias("_first"),
    )
    if row_column is not None:
        return _with_rows(docs, winners, id_column, row_column, norm, order, salts)
    members = docs.select(F.col(id_column).cast("bigint").alias(id_column), F.sha2(norm, 256).alias("_digest"))
    return salted_lookup(members, winners, ["_digest"], F.col(id_column), salts, "inner").select(
        id_column, "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        F.col(id_column).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("text_sha256"),
    )


def _with_rows(docs: DataFrame, winners: DataFrame, id_column: str, row_column: str, norm: Column, order: Column, salts: int) -> DataFrame:
    members = docs.select(
        F.col(id_column).cast("bigint").alias(id_column), F.col(row_column).alias("_row"), F.sha2(norm, 256).alias("_digest"), order.alias("_best"))
    judged = cut_lineage(salted_lookup(members, winners, ["_digest"], F.col("_row"), salts, "inner"))
    # rows of one id and length, or without id: only classes that have several of them meet their rows again
    first = judged.where("_best = _first").groupBy("_digest").agg(F.min("_row").alias("_stays"), F.count(F.lit(1)).alias("_tied")).where("_tied > 1")
    ranked = judged.where("_best = _first")
    gone = salted_lookup(ranked, first, ["_digest"], F.col("_row"), salts, "inner").where("_row <> _stays").select(F.col("_row").alias("_gone"))
    rows = judged.join(gone, F.col("_row") == F.col("_gone"), "left")
    return rows.select(
        id_column, F.col("_row").alias(row_column), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        ((F.col("_best") == F.col("_first")) & F.col("_gone").isNull()).alias("kept"), F.col("_digest").alias("text_sha256"),
    )
