"""Exact de-duplication and repair of colliding ids, both by the global order of the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.functions.text import short_id, text_key


def first_of_each_text(chunks: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """The first chunk of each text, texts that differ only in case and white space being one.

    The first of a text is found by an aggregate that combines before its shuffle, so a text that is
    a third of all rows is a few rows when they leave their tasks. Null counts as an empty text.
    """
    keyed = chunks.withColumn("_key", text_key(F.col(text)))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias(order))
    return keyed.join(firsts.select(order), order, "left_semi").drop("_key")


def repair_ids(chunks: DataFrame, id_column: str = "chunk_id", order: str = "ord") -> DataFrame:
    """Give the second and later chunks of an id one that is derived from it and its place.

    The place is the number of chunks before it, which is a count over the whole order. Only ids and
    order numbers are counted; the few places that matter are joined to the chunks.
    """
    keys = chunks.select(id_column, order)
    counted = keys.groupBy(id_column).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(id_column, "_first")
    late = positions(keys, order).join(counted, id_column).filter(F.col(order) > F.col("_first")).select(order, "_position")
    derived = short_id(F.col(id_column), F.col("source"), F.col("path"), F.col("_position"))
    return chunks.join(late, order, "left").withColumn(id_column, F.when(F.col("_position").isNotNull(), derived).otherwise(F.col(id_column))).drop("_position").select(*chunks.columns)


def positions(rows: DataFrame, order: str, column: str = "_position", block: int = 65_536) -> DataFrame:
    """The number of rows before each, by block sums: no task sorts more than a block of the order.

    ``order`` holds whole numbers; gaps and large values are fine, repeats are numbered arbitrarily.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    sums = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    # one row for each block of the order, a 65,536th of the rows
    before = sums.select("_block", F.coalesce(F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return cut.withColumn("_inside", inside).join(before, "_block").withColumn(column, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")
