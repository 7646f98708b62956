"""Order-preserving greedy packing and interval merging on tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_groups(df: DataFrame, key: str, order: str, size: str, limit: float, group: str = "group") -> DataFrame:
    """(key, order, size, group): each row joins the group before it if the group's sizes stay within ``limit``; a row that
    is larger than that stands alone. Groups are numbered from 0 in each key.

    One pass over a key's ordered rows, which holds the open group's size only: packing depends on all rows before, so a key
    (a document) is one task's. Equal keys lie together; null ones and NaN are keys too.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(F.col(key), F.col(order), F.col(size).cast("double").alias(size)).repartition(4 * slots, key).sortWithinPartitions(key, order, size)
    schema = T.StructType([*rows.schema.fields, T.StructField(group, T.IntegerType())])

    def run(batches):
        open_key, number, total = object(), -1, None
        for b in batches:
            found = []
            for k, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != open_key and not (k != k and open_key != open_key):
                    open_key, number, total = k, -1, None
                large = s is not None and (s > limit or s != s)
                if large or total is None or (s is not None and total + s > limit):
                    number += 1
                    total = None if large else s
                else:  # a missing size joins the open group and closes it
                    total = None if s is None else total + s
                found.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def merge_intervals(df: DataFrame, key: str, start: str, end: str, penalty: str, tie: str) -> DataFrame:
    """Overlapping intervals of a key as one (touching ones stay apart): key, start, end, penalty (the highest)."""
    order = Window.partitionBy(key).orderBy(start, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_island", island).groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(penalty).alias(penalty)).drop("_island")
