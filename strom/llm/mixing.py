"""Mixes sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strom.llm.shared import SPACES
from strom.operators.sizes import join_to_dimension
from strom.session import cut_lineage

WEIGHTS = (5, 2, 1)
_RANK_BITS, _CELL_BITS = 40, 10
_MAX_BROADCAST = 200_000


def word_count(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def appeal(size: Column) -> Column:
    """Relative wish for a document by its length: the bits of its size, so longer ones repeat a little more often."""
    return F.length(F.bin(size)).cast("int")


def _uniform(id_column: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Words wanted of each source. ``sizes`` has ``_key``, ``source``, ``source_size``, one row per source.

    Sources in code point order, null last, take the weights in turn. A source stops at ``cap`` times its own size; what it
    leaves goes to the others by weight: sources are taken by rising size per weight, and one is full if the level
    that the rest would reach covers its limit. One row per source runs through one task here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    all_rows = Window.partitionBy(F.lit(0))
    up = all_rows.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_weight", weight).withColumns({
        "_all": F.lit(share) * F.sum("source_size").over(all_rows),
        "_rest": F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)),
        "_full_before": F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
    })
    rows = rows.withColumn("_full", (F.col("_all") - F.col("_full_before")) * F.col("_weight") >= F.lit(cap) * F.col("source_size") * F.col("_rest"))
    full = F.lit(cap) * F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(F.lit(0))).over(all_rows)
    open_weight = F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("_weight"))).over(all_rows)
    target = F.when(F.col("_full"), F.lit(cap) * F.col("source_size")).otherwise((F.col("_all") - full) * F.col("_weight") / open_weight)
    return rows.select("_key", "source_size", target.cast("double").alias("target"))


def _expected(bands: DataFrame, cap: float) -> DataFrame:
    """Copies to expect of a document per source and appeal: proportional to the appeal, ``cap`` at most, and in words the target."""
    source = Window.partitionBy("_key")
    down = source.orderBy(F.col("_appeal").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    wish = F.col("_appeal") * F.col("_words")
    rows = bands.withColumns({
        "_rest": F.sum(wish).over(source) - F.coalesce(F.sum(wish).over(before), F.lit(0)),
        "_full_before": F.lit(cap) * F.coalesce(F.sum("_words").over(before), F.lit(0)),
    })
    rows = rows.withColumn("_full", (F.col("target") - F.col("_full_before")) * F.col("_appeal") >= F.lit(cap) * F.col("_rest"))
    full = F.lit(cap) * F.sum(F.when(F.col("_full"), F.col("_words")).otherwise(F.lit(0))).over(source)
    open_wish = F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(wish)).over(source)
    copies = F.when(F.col("_full"), F.lit(cap)).otherwise((F.col("target") - full) * F.col("_appeal") / open_wish)
    rows = rows.withColumn("_copies", F.least(F.lit(cap), F.greatest(F.lit(0.0), copies))).withColumn("_whole", F.floor("_copies").cast("bigint"))
    return rows.withColumns({"_odds": F.col("_copies") - F.col("_whole"), "_left": F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(source)})


def pareto_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
               share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, row_column: str | None = None) -> DataFrame:
    """Copies of each document in a mix that comes near every source's target in words.

    A document expects copies in proportion to its appeal, ``cap`` at most. The whole part of that is certain. For the
    rest p, documents of a source are ranked by u/(1-u) over p/(1-p), u uniform by a hash of id and seed, and taken in that
    order up to the words still missing; the document across the boundary is taken if more than half of it fits. The boundary
    is found by sums over cells of the rank, twice refined, so no source is sorted as a whole.

    Columns: id, source, size, source_size, target, copies, taken. Null texts are empty and take no part, null sources form a
    source of their own, rows that repeat an id share u and are ranked side by side. Other columns are not read.
    With ``row_column``, a key of each row, that is a column more and decides between equal ranks, and rows without id draw u by their text.
    """
    row = F.lit(0).cast("bigint") if row_column is None else F.col(row_column)
    drawn_by = F.col(id_column).cast("string")
    if row_column is not None:
        drawn_by = F.coalesce(drawn_by, F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_column), F.lit("")))))
    rows = docs.select(F.col(id_column).alias("_id"), row.alias("_row"), F.col(source_column).cast("string").alias("source"),
                       word_count(F.col(text_column)).alias("size"), _uniform(drawn_by, seed).alias("_u"))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = cut_lineage(rows.withColumn("_appeal", appeal(F.col("size"))))
    bands = cut_lineage(rows.groupBy("_key", "source", "_appeal").agg(F.sum("size").alias("_words")))
    sources = bands.groupBy("_key", "source").agg(F.sum("_words").alias("source_size"))
    targets = cut_lineage(source_targets(sources, share, cap, weights))
    plan = cut_lineage(_expected(bands.join(targets, "_key"), cap).select(
        "_key", "_appeal", "source_size", "target", "_whole", "_odds", "_left"))
    rows = join_to_dimension(rows, plan, ["_key", "_appeal"], "inner", _MAX_BROADCAST, F.col("_id"))
    rank = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_odds") / (1 - F.col("_odds")))
    # rank / (1 + rank) keeps the order and lies between 0 and 1; as an integer its cells are exact
    number = F.floor(rank / (1 + rank) * float(1 << _RANK_BITS)).cast("bigint")
    ranked = cut_lineage(rows.withColumn("_rank", F.when((F.col("_odds") > 0) & (F.col("size") > 0), number)))
    wanted = plan.groupBy("_key").agg(F.max("_left").alias("_want"))
    # per source: ranks whose leading bits are below _cell are taken, _taken words in all; the boundary has _cell as leading bits
    edge, shift = wanted.select("_key", "_want", F.lit(0).cast("bigint").alias("_cell"), F.lit(0).cast("bigint").alias("_taken")), _RANK_BITS
    for _ in range(2):
        edge, shift = cut_lineage(_refine(ranked, edge, shift)), shift - _CELL_BITS
    mix = _finish(ranked, edge, shift, id_column)
    return mix.drop("_row") if row_column is None else mix.withColumnRenamed("_row", row_column)


def _within(ranked: DataFrame, edge: DataFrame) -> DataFrame:
    return join_to_dimension(ranked, edge, ["_key"], "inner", _MAX_BROADCAST, F.col("_id"))


def _refine(ranked: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
    """The finer cell of each source in which the words wanted are reached; the last one with rows if they never are."""
    inside = _within(ranked, edge).where(F.shiftright("_rank", shift) == F.col("_cell"))
    sums = inside.groupBy("_key", F.shiftright("_rank", shift - _CELL_BITS).alias("_part")).agg(F.sum("size").alias("_words"))
    order = Window.partitionBy("_key").orderBy("_part")  # at most one row per cell
    upto = sums.withColumn("_sum", F.sum("_words").over(order)).join(edge, "_key")
    reached = F.when(F.col("_taken") + F.col("_sum") >= F.col("_want"), F.struct("_part", (F.col("_taken") + F.col("_sum") - F.col("_words")).alias("_before")))
    last = F.struct("_part", (F.col("_taken") + F.col("_sum") - F.col("_words")).alias("_before"))
    found = upto.groupBy("_key").agg(F.coalesce(F.min(reached), F.max(last)).alias("_to"))
    return edge.join(found, "_key", "left").select(
        "_key", "_want", F.coalesce(F.col("_to._part"), F.lit(0)).alias("_cell"), F.coalesce(F.col("_to._before"), F.col("_taken")).alias("_taken"))


def _finish(ranked: DataFrame, edge: DataFrame, shift: int, id_column: str) -> DataFrame:
    cell = F.shiftright("_rank", shift)
    rows = _within(ranked, edge)
    columns = [F.col("_id").alias(id_column), "_row", "source", "size", "source_size", "target", "_whole"]
    order = Window.partitionBy("_key").orderBy("_rank", F.col("_id").asc_nulls_last(), "size", "_row")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = rows.where(cell == F.col("_cell")).select(*columns, (F.col("_taken") + upto - F.col("size") / 2 <= F.col("_want")).alias("_drawn"))
    rest = rows.where(cell.isNull() | (cell != F.col("_cell"))).select(*columns, F.coalesce(cell < F.col("_cell"), F.lit(False)).alias("_drawn"))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("_drawn").cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return rest.unionByName(near).withColumn("copies", copies).select(
        id_column, "_row", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
