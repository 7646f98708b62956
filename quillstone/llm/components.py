"""Connected components by alternating large-star and small-star steps, the classes and components of rows that are linked,
and sorted-group streaming for Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Hang every (larger) neighbour of a node on the least of the node and its (smaller) neighbours; and the table of
    those least nodes, which the result reads."""
    pairs = edges if not large else edges.union(edges.select("b", "a"))
    # written before it is joined: both sides of the join are then dealt out for it alone, and Spark can split a hub's rows
    least = scratch.table(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = pairs.join(least, "a")
    if large:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct(), least


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of ids); root is the component's least node.

    Each round is written to the shared scratch folder and the tables of the one before are removed. Rows are a pair of
    ids, minima are taken before the shuffle and the joins are ones whose skewed partitions Spark splits, so a component
    of any size is fine; rounds grow with the logarithm of the longest path. Loops and repeated edges do not matter; no
    edges give no rows.
    """
    scratch = scratch or Scratch()
    a, b = edges.columns
    now = scratch.table(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "stars")
    state = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(found) == state or not found[0]:
            break
        state, before = tuple(found), now
        large, first = _star(now, True, scratch)
        small, second = _star(large, False, scratch)
        now = scratch.table(small, "stars")
        scratch.drop(before, first, second)
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def representative(key: str, rid: str) -> Column:
    """Of a group's rows the one that stands for it: least id (nulls last), then least row number."""
    return F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(rid).alias("rid")))


def resolve(rows: DataFrame, classes: DataFrame, found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``rows`` (rid, digest, ``key``, others) with class_id, n_links, component_id, kept (the row has that id) and chosen
    (the one row that stands for the component).

    ``classes`` has a row for each digest: cls, rep (see ``representative``), copies. ``found`` has for each class of a
    comparison: links (rows of other classes linked in it), root (the least class it is connected to there), settled (no
    other comparison connects it). Rows without a digest link with nothing and stand for themselves.
    """
    across = components(found.where("not settled").select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    linked = across.select(F.col("node").alias("cls"), "root").union(found.where("settled").select("cls", "root"))
    info = found.groupBy("cls").agg(F.sum("links").alias("links")).join(linked, "cls").join(classes.select("cls", "rep"), "cls")
    best = info.groupBy("root").agg(F.min("rep").alias("best"))
    info = info.join(best, "root").select("cls", "links", "best")
    # written before it is joined, so that the rows of a large class are dealt out for this join alone and can be split
    info = scratch.table(classes.select("digest", "cls", "rep", "copies").join(info, "cls", "left").drop("cls"), "info")
    out = rows.join(info, "digest", "left").withColumn("_least", F.coalesce("best", "rep"))
    component = F.coalesce("_least.id", key)
    return out.withColumns({
        "class_id": F.coalesce("rep.id", key),
        "n_links": (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long"),
        "component_id": component,
        "kept": F.coalesce(F.col(key) == component, F.lit(True)),
        "chosen": F.coalesce(F.col("rid") == F.col("_least.rid"), F.lit(True)),
    })


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (i, j) connect it to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(batches, key: list[str]):
    """From batches sorted by ``key``, one table for each run of equal keys, gathered across batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if keys[i] != last and held:
                yield last, pa.concat_tables(held)
                held = []
            last = keys[i]
            held.append(table.slice(i, j - i))
    if held:
        yield last, pa.concat_tables(held)
