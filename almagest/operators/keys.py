"""One row per key, by an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RANK = "__rank"


def unnest(df: DataFrame, array: Column, keep: list[Column | str], pos: str, value: str) -> DataFrame:
    """One row per array element with its position; null and empty arrays give none.

    The outer generator with a test on its own output is used on purpose. For the inner
    one the optimizer adds a size test on the array and moves it below the projection
    that computes the array, so that the array would be computed twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def computed_once(df: DataFrame, keep: list[Column | str], fields: list[Column]) -> DataFrame:
    """Select costly columns so that they are evaluated exactly once per row.

    A later filter on a plain projection is moved below it, and then every column it
    uses is computed again there, once per mention. Passing the columns through a
    one-element generator ends that: filters on its output stay above it.
    """
    row = "__row"
    names = [row + "." + f for f in df.select(F.struct(*fields).alias(row)).schema[row].dataType.names]
    kept = df.select(*keep).columns
    return df.select(*keep, F.explode_outer(F.array(F.struct(*fields))).alias(row)).select(*kept, *names)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of every key.

    Spark plans the filtered row_number as WindowGroupLimit: each task first cuts
    its own rows to one per key, so a key that owns a third of the table costs one
    row per task in the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(RANK, F.row_number().over(window)).where(F.col(RANK) == 1).drop(RANK)


def numbered(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str) -> DataFrame:
    """Number the rows of every key from 0, with one key spread over many tasks.

    `chunk` must not decrease along `order`. Rows are numbered inside (key, chunk);
    the offset of a chunk is the running total of the counts before it, which needs
    one small row per chunk.
    """
    part = "__chunk"
    cut = df.withColumn(part, chunk)
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    return (
        cut.withColumn("__pos", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, part])
        .withColumn(name, F.col("__pos") + F.col("__offset"))
        .drop("__pos", "__offset", part)
    )
