"""Running values along a file, a conversation or any other ordered key, without one task for each key.

A window over a whole file puts that file into one task. Here the rows of a key are cut into blocks of line numbers;
running values are taken within blocks, the blocks' totals are run over once more, and the two are put together. The
second step has one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.shared import kept

BLOCK = 1 << 16


def _combine(how: str, a: Column, b: Column) -> Column:
    """What a comes to when b follows it; either may be null."""
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if how == "max" else F.coalesce(b, a)


def carry(df: DataFrame, key: list[str], line: str, block: int = BLOCK, **values: tuple[str, Column]) -> DataFrame:
    """df with a running value for each name: ("sum" | "max" | "last", expression), up to and including the row.

    line: a whole number that orders a key's rows. "last" is the last value that isn't null.
    """
    rows = df.withColumn("_block", F.floor(F.col(line) / block))
    for name, (_, value) in values.items():
        rows = rows.withColumn(f"_v_{name}", value)
    inside = Window.partitionBy(*key, "_block").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    fold = {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}
    totals = {"sum": F.sum, "max": F.max, "last": lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col(line)))}
    blocks = rows.groupBy(*key, "_block").agg(*(totals[how](f"_v_{n}").alias(n) for n, (how, _) in values.items()))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select(*(F.col(x).alias(f"_k_{x}") for x in key), F.col("_block").alias("_b"), *(fold[how](n).over(before).alias(f"_h_{n}") for n, (how, _) in values.items()))
    same = F.col("_block") == F.col("_b")
    for x in key:
        same = same & F.col(x).eqNullSafe(F.col(f"_k_{x}"))
    for n, (how, _) in values.items():
        rows = rows.withColumn(f"_r_{n}", fold[how](f"_v_{n}").over(inside))
    out = rows.join(heads, same, "left")
    for n, (how, _) in values.items():
        out = out.withColumn(n, _combine(how, F.col(f"_h_{n}"), F.col(f"_r_{n}")))
    return out.select(*(x for x in df.columns if x not in values), *values)


def previous(df: DataFrame, key: list[str], line: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the value of the row before (by line, of the same key), across block borders."""
    rows = df.withColumn("_block", F.floor(F.col(line) / block))
    w = Window.partitionBy(*key, "_block").orderBy(line)
    rows = rows.withColumn("_in", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = rows.groupBy(*key, "_block").agg(F.max_by(value, line).alias("_end"))
    heads = ends.select(*(F.col(x).alias(f"_k_{x}") for x in key), F.col("_block").alias("_b"), F.lag("_end").over(Window.partitionBy(*key).orderBy("_block")).alias("_head"))
    same = F.col("_block") == F.col("_b")
    for x in key:
        same = same & F.col(x).eqNullSafe(F.col(f"_k_{x}"))
    out = rows.join(heads, same, "left").withColumn(name, F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_in")))
    return out.select(*(x for x in df.columns if x != name), name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place, from 1, in a total order of all rows.

    Rows are dealt by ranges of the order and written out, so that both passes see the same ranges; each range is numbered
    on its own and moved by the counts of the ranges before it, one row for each range.
    """
    ranges = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = ranges.withColumn("_own", own).join(counts.select("_range", before.alias("_before")), "_range")
    return out.select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def near_rows(df: DataFrame, key: list[str], order: list[str], before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """df with _n (the row's place among all rows by key and order), _block and _own, and so many rows around each block once more.

    A window over (key, _block) by _n then sees, for rows with _own, the same neighbours as one over the whole key would,
    up to `before` and `after` rows away; blocks hold at most `block` rows besides those, however many a key has.
    """
    rows = numbered(df, [*key, *order], "_n")
    at, place = F.floor(F.col("_n") / block), F.col("_n") % block
    also = F.array(at, F.when(place >= block - before, at + 1), F.when(place < after, at - 1))
    copies = rows.withColumn("_block", F.explode(F.filter(also, lambda x: x.isNotNull())))
    return copies.withColumn("_own", F.col("_block") == at)
