"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u a hash of the row's key and the
child's path, and the least draw wins. A child's draw depends on its own path and weight alone, so changing a weight
moves rows only into or out of the subtree whose weight changed. A shard added as a region of its own therefore takes
rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import Scratch

#: Parts of each shard that are numbered apart, so that slots need no task that sees a whole shard; and how many copies of
#: one row are written out by one task.
PARTS, RUN = 256, 1 << 16

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def topology(regions: int = 3, racks: int = 4, shards: int = 2) -> Tree:
    """An even tree; its shards are numbered from 0 in order."""
    each = racks * shards
    return {f"region{r}": {f"rack{k}": {r * each + k * shards + s: 1.0 for s in range(shards)} for k in range(racks)} for r in range(regions)}


def grown(tree: Tree) -> Tree:
    """``tree`` with one more shard, in a region and rack of its own."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"region+{new}": {"rack0": {new: 1.0}}}


def _draw(key: Column, path: str, weight: float) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(uniform) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, object]]) -> Column:
    """The value of the child with the least draw (ties: the least value)."""
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.array_min(F.array(*[F.struct(_draw(key, path, w).alias("d"), F.lit(v).alias("v")) for path, w, v in children]))["v"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that ``key`` (a string column) descends to."""
    weigh = lambda racks: sum(sum(s.values()) for s in racks.values())
    region = _winner(key, [(r, weigh(racks), r) for r, racks in tree.items() if weigh(racks) > 0])
    by_region = None
    for r, racks in tree.items():
        rack = _winner(key, [(f"{r}/{k}", sum(s.values()), k) for k, s in racks.items() if sum(s.values()) > 0])
        by_rack = None
        for k, shards in racks.items():
            leaf = _winner(key, [(f"{r}/{k}/{s}", w, s) for s, w in shards.items() if w > 0])
            by_rack = F.when(rack == k, leaf) if by_rack is None else by_rack.when(rack == k, leaf)
        by_region = F.when(region == r, by_rack) if by_region is None else by_region.when(region == r, by_rack)
    return by_region.cast("int")


def place(df: DataFrame, tree: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size (UTF-8 bytes of the text plus 8), text_crc32, law ("key"), shard, slot, grown_shard.

    The key alone decides the shard, so equal keys meet; a null key is placed by the checksum and size of its text.
    A null text has size 8 and the checksum of the empty text. Slots number each shard's rows from 0 without gaps, in
    the order of part, key, checksum and size; rows equal in all of these take neighbouring slots. Such rows are counted
    before anything is shuffled and written out again at the end, a run of slots a task, and the rows of one key are in
    parts by their texts, so neither a row nor a key that many rows have lands in one task. Only ``key`` and ``text`` are
    read, so other columns cannot clash; an empty table gives no rows.
    """
    tree = tree or topology()
    narrow = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("null"), "text_crc32", "size"))
    same = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    placed = same.withColumn("_key", name).select(
        "doc_id", "size", "text_crc32", "_n", shard_of(F.col("_key"), tree).alias("shard"), shard_of(F.col("_key"), grown(tree)).alias("grown_shard"),
        F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(PARTS)).cast("int").alias("_part"),
    )
    scratch = Scratch()
    placed = scratch.table(placed, "shards")
    counts = placed.groupBy("shard", "_part").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x PARTS rows, whatever the input
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_rank", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(starts), ["shard", "_part"])
    slots = scratch.table(ranked.withColumn("_first", F.col("_start") + F.col("_rank")).drop("_start", "_rank", "_part"), "slots")
    scratch.close(slots)
    runs = slots.where(F.col("_n") > RUN).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    runs = runs.withColumn("_first", F.col("_first") + F.col("_at")).withColumn("_n", F.least(F.col("_n") - F.col("_at"), F.lit(RUN)))
    # by number, as Spark would put runs together by the size of what it reads, not of what they become
    runs = runs.drop("_at").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_first")
    every = slots.where(F.col("_n") <= RUN).unionByName(runs)
    slot = F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias("slot")
    return every.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
