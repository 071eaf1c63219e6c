"""Top rows per group without handing a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int | Column, rank: str | None = None) -> DataFrame:
    """Rows ranked 1..limit within each group by ``order``, which must be a total order.

    A literal limit is applied before the shuffle by the window group limit. Without keys the table is one group: its top
    rows are taken first, by partitions, and only they are ranked.
    """
    name = rank or "__rank"
    if not keys:
        df = df.orderBy(*order).limit(limit)
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= limit)
    return ranked if rank else ranked.drop(name)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)
