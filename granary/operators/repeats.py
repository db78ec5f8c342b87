"""First-wins de-duplication of rows by key, and orders that sources take turns in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.workspace import shared_dir


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, by a grouped minimum: a hot key is summed up where it is read."""
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in rows.columns if c not in keys)), place).alias("_first")).select(*keys, "_first.*").select(*rows.columns)


def last_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as an upsert leaves it."""
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c not in keys)), place).alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place (from 1) in their group, without a group ever meeting in one task.

    Rows are dealt by ranges of ``groups`` and ``order`` (together unique), numbered in
    their range, and shifted by the group's rows in the ranges before: one sum for each
    group and range. The dealt rows are written to the shared folder.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "numbered")
    # Dealing by ranges reads its rows twice, so what they are made of is worked out before that.
    rows.write.parquet(f"{path}/rows")
    made = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    # Written once: a range that were dealt again might hold other rows.
    made.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *groups, *order).withColumn("_range", F.spark_partition_id()).write.parquet(f"{path}/dealt")
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(f"{path}/dealt")
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order)))
    counts = dealt.groupBy("_range", *groups).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("_range").alias("_s_range"), *(F.col(c).alias(f"_s_{c}") for c in groups), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_s_range")
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return local.join(shift, same).select(*rows.columns, (F.col("_at") + F.col("_before")).alias(name))


def by_turns(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``rows`` with ``turn``: the place of a row in its source. Ordered by turn and source, the sources take turns."""
    return numbered(rows, [source], order, "turn")


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")
