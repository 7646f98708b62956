"""Shared helpers: scratch tables in the cluster's shared folder, bounded label samples, Arrow batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python, the same for every operator of a session: batches of very long texts
#: stay small. Kernels that want fewer rows cut the batches themselves (``slices``).
BATCH_ROWS, BATCH_BYTES = 256, 1 << 23
#: Longest key that a cache keeps, and characters of keys for each entry of its limit.
KEY_CHARS, MEAN_CHARS = 64, 16


class Kept(dict):
    """A bounded cache: a dict that computes missing values. When full, it becomes the old generation, from which what is
    asked for again moves on. It holds at most twice ``limit`` entries, with keys of ``MEAN_CHARS`` characters in the mean;
    keys of more than ``longest`` characters are computed each time and never held."""

    def __init__(self, make, limit: int, longest: int = KEY_CHARS):
        self.make, self.limit, self.longest, self.old, self.chars = make, limit, longest, {}, 0

    def __missing__(self, key):
        n = len(key)
        if n > self.longest:
            return self.make(key)
        if len(self) >= self.limit or self.chars > self.limit * MEAN_CHARS:
            self.old, self.chars = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.chars += n
        return value


def release() -> None:
    """Give a worker's freed memory back to the system: workers live on for other stages, whose caches come on top."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes. Settings are read when a plan is executed, so they have one value only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches, rows: int):
    """The batches, cut into ones of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a
    cluster it is an error, as executors would write to disks of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    return _write(df, name)[0]


class Scratch:
    """The scratch tables of one call, so that those which nothing returned reads can be removed."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(_write(df, name))
        return self.tables[-1][0]

    def drop(self, *frames: DataFrame) -> None:
        """Remove these tables."""
        for df, path in self.tables:
            if any(df is f for f in frames):
                _remove(df.sparkSession, path)
        self.tables = [t for t in self.tables if not any(t[0] is f for f in frames)]

    def close(self, *kept: DataFrame) -> None:
        """Remove all tables but these."""
        self.drop(*[df for df, _ in self.tables if not any(df is k for k in kept)])


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, with underscores added until none is that of a column (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def lowest(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all values. Put before a limit in order of the hash, it keeps
    the limit's one task from getting a full limit of rows from each partition."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2.0**64) - (1 << 63))


def crc_fold(column: str, folds: int):
    """crc32(id as text) mod ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def crc_fold_py(value: int, folds: int) -> int:
    return zlib.crc32(str(value).encode()) % folds


#: Characters that the texts of one class may have together in a labelled sample.
SAMPLE_CHARS = 24_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int):
    """The texts of at most ``per_class`` labelled ids of each class from the folds that are not held out, of at most
    ``SAMPLE_CHARS`` characters together: texts are taken whole, and one that does not fit any more is left out by itself.

    The choice is by a hash of the id (of an id with several texts, one is taken in each turn), so it does not depend on
    file order or partitioning. Rows with a null id, label or other label value than 0 and 1 are skipped; an id labelled
    twice counts with its larger label; repeated rows count once. A class none of whose texts fits is an error.
    Returns a list of (text, label) on the driver, of bounded size.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    scratch = Scratch()
    ids = scratch.table(ids.where(crc_fold("_id", folds) != held_out).distinct(), "labelled")
    sizes = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        enough = (4 * per_class + 100) / max(1, sizes.get(y, 0))  # so that the limit is reached beyond all doubt
        part = ids.where((F.col("_y") == y) & lowest(F.xxhash64("_id"), enough)).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    found = found.withColumns({"_hash": F.xxhash64("text"), "_chars": F.length("text").cast("long")})
    found = scratch.table(found.dropDuplicates(["_y", "doc_id", "_hash"]), "sample")
    chars = {r["_y"]: r["n"] for r in found.groupBy("_y").agg(F.sum("_chars").alias("n")).collect()}
    if any(n > SAMPLE_CHARS for n in chars.values()):
        turn = F.row_number().over(Window.partitionBy("_y", "doc_id").orderBy("_hash"))
        listed = found.drop("text").withColumn("_turn", turn).orderBy("_turn", F.xxhash64("_id"), "_id", "doc_id")
        room, taken = dict.fromkeys(chars, SAMPLE_CHARS), []
        for r in listed.toLocalIterator():
            if r["_chars"] <= room[r["_y"]]:
                room[r["_y"]] -= r["_chars"]
                taken.append((r["_y"], r["doc_id"], r["_hash"]))
        for y, n in chars.items():
            if n and room[y] == SAMPLE_CHARS:
                raise ValueError(f"every labelled text with {label} = {y} is longer than {SAMPLE_CHARS} characters")
        keys = ["_y", "doc_id", "_hash"]
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(taken, found.select(*keys).schema)), keys)
    best: dict = {}
    for r in found.select("doc_id", "text", "_y").collect():
        key = (r["doc_id"], r["text"])
        best[key] = max(best.get(key, 0), r["_y"])
    scratch.close()
    return [(text, y) for (_, text), y in sorted(best.items())]
