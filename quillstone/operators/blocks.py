"""Documents as tables of blocks, and the heading hierarchy by window functions over them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..markdown.blocks import Blocks
from ..markdown.chunking import parsed
from ..markdown.nodes import content_size, from_units, plain_text, units
from ..markdown.options import Options
from ..markdown.serialise import serialise
from ..sources import BATCH_BYTES, bounded_batches

BLOCK = "idx int, type string, depth int, content_size int, plain string, markdown string"
DEPTHS = range(1, 7)
#: Blocks in one batch handed back.
BLOCK_ROWS = 4096


def blocks(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: dict | None = None) -> DataFrame:
    """One row a top-level block: ``keep``, idx, type, depth (of headings), content_size, plain, markdown. Without rules a
    document's blocks are handed on as they are read, so that memory does not grow with their number."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    options = Options(1, rules=rules or {})
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(BLOCK).fields])

    if not df.isStreaming:
        bounded_batches(df.sparkSession)
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def top(text: str):
        return parsed(text, options).children if options.rules else Blocks(units(text)).nodes()

    def run(batches):
        for b in batches:
            rows, made, held = [], [], 0

            def batch(b=b):
                cols = list(zip(*made)) or [()] * 6
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in b.columns[:-1]), *map(pa.array, cols, kinds)], names=schema.names)

            for r in range(b.num_rows):
                t = b.column(len(keep))[r].as_py()
                for i, n in enumerate(top(t) if t else ()):
                    rows.append(r)
                    made.append((i, n.type, getattr(n, "depth", None), content_size(n), from_units(plain_text(n)), from_units(serialise(n)).rstrip("\n")))
                    held += len(made[-1][-1])
                    if len(rows) >= BLOCK_ROWS or held > BATCH_BYTES:
                        yield batch()
                        rows, made, held = [], [], 0
            yield batch()

    return source.mapInArrow(run, schema)


def section_paths(table: DataFrame, key: str) -> DataFrame:
    """``table`` (of blocks) with ``path``: idx of the headings above each block (a heading's own not among them), and
    ``section``: idx of the first block of its top-level section.

    A thematic break closes all open headings behind it. Blocks that no heading governs form one section as long as they
    follow each other at the top. All by windows over (key, order by idx).
    """
    order = Window.partitionBy(key).orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key, "_chain").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = table.withColumn("_chain", F.coalesce(F.sum((F.col("type") == "thematicBreak").cast("int")).over(before), F.lit(0)))
    last = {d: F.max(F.when((F.col("type") == "heading") & (F.col("depth") == d), F.col("idx"))).over(so_far) for d in DEPTHS}
    t = t.select("*", *[last[d].alias(f"_h{d}") for d in DEPTHS])

    def live(d: int) -> Column:
        higher = [F.coalesce(F.col(f"_h{k}"), F.lit(-1)) for k in range(1, d)]
        return F.col(f"_h{d}").isNotNull() & (F.col(f"_h{d}") > (F.greatest(*higher) if len(higher) > 1 else higher[0] if higher else F.lit(-1)))

    above = F.array_compact(F.array(*[F.when(live(d) & (F.col(f"_h{d}") < F.col("idx")), F.col(f"_h{d}")) for d in DEPTHS]))
    # a heading ends deeper and equal ones before it: they are not above it
    own = F.when(F.col("type") == "heading", F.col("depth")).otherwise(F.lit(7))
    above = F.when(F.col("type") == "heading", F.array_compact(F.array(*[F.when(live(d) & (F.col(f"_h{d}") < F.col("idx")) & (F.lit(d) < own), F.col(f"_h{d}")) for d in DEPTHS]))).otherwise(above)
    t = t.withColumn("path", above)
    orphan = (F.size("path") == 0) & (F.col("type") != "heading")
    starts = F.when(F.size("path") > 0, F.element_at("path", 1)).when(F.col("type") == "heading", F.col("idx"))
    t = t.withColumn("_orphan", orphan).withColumn("_start", starts)
    first = F.col("_orphan") & ~F.coalesce(F.lag("_orphan").over(order), F.lit(False))
    island = F.max(F.when(first, F.col("idx"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.withColumn("section", F.when(F.col("_orphan"), island).otherwise(F.col("_start"))).drop("_chain", "_orphan", "_start", *[f"_h{d}" for d in DEPTHS])


def section_sizes(table: DataFrame, key: str) -> DataFrame:
    """Per heading: key, idx, depth, plain, section_size (heading and everything in its section)."""
    paths = section_paths(table, key)
    inside = paths.select(key, F.explode(F.concat("path", F.when(F.col("type") == "heading", F.array("idx")).otherwise(F.array().cast("array<int>")))).alias("_of"), "content_size")
    sizes = inside.groupBy(key, "_of").agg(F.sum("content_size").alias("section_size"))
    heads = table.where("type = 'heading'").select(key, "idx", "depth", "plain")
    return heads.join(sizes.withColumnRenamed("_of", "idx"), [key, "idx"])
