"""The chunker as a DataFrame operator and as a table function for SQL."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..markdown.chunking import NodeSplitter, Splitter, chunks, parsed
from ..markdown.nodes import from_units
from ..markdown.options import Options
from ..markdown.serialise import serialise
from ..sources import bounded_batches

CHUNK = "chunk_index int, text string, breadcrumbs array<struct<text:string,depth:int>>"
_CRUMBS = pa.list_(pa.struct([("text", pa.string()), ("depth", pa.int32())]))


@dataclass(frozen=True)
class Chunker:
    """Splits documents into chunks under fixed ``options``; works alike on one text, on batch and on streaming tables.
    ``splitters`` are splitters of one's own for kinds of blocks (see ``NodeSplitter``)."""

    options: Options
    splitters: Mapping[str, NodeSplitter] = field(default_factory=dict)

    @property
    def chunk_size(self) -> float:
        return self.options.chunk_size

    @property
    def max_overflow_ratio(self) -> float:
        return self.options.max_overflow_ratio

    @property
    def max_raw_size(self) -> int | None:
        return self.options.max_raw_size

    def split(self, text: str | None) -> list[dict]:
        """The chunks of one text: {text, breadcrumbs: [{text, depth}]}."""
        return [{"text": t, "breadcrumbs": [{"text": c, "depth": d} for c, d in crumbs]} for t, crumbs in chunks(text, self.options, self.splitters)]

    def split_text(self, text: str | None) -> list[str]:
        return [t for t, _ in chunks(text, self.options, self.splitters)]

    def split_nodes(self, text: str) -> list:
        """Each chunk's syntax tree."""
        return [parsed(t, Options(1, rules={})) for t in self.split_text(text)]

    def split_blocks(self, text: str) -> list[str]:
        """The tree splitter alone: no default rules are implied, no cap is applied."""
        found = Splitter(self.options, self.splitters).split(parsed(text, self.options).children)
        return [m for n in found if (m := from_units(serialise(n)).strip())]

    def transform(self, df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """One row a chunk: the columns ``keep`` (all but ``text``, if not given), chunk_index, text, breadcrumbs.

        The rows of a document stay in order and a document without chunks (null, empty, blank) gives none. A kept column
        named like a new one is an error. Each document is handled by one task; nothing is shuffled.
        """
        keep = [c for c in df.columns if c != text] if keep is None else keep
        schema = T._parse_datatype_string(CHUNK)
        if clash := set(keep) & set(schema.names):
            raise ValueError(f"columns {sorted(clash)} clash with those of the chunks")
        if not df.isStreaming:
            bounded_batches(df.sparkSession)
        source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
        options, splitters = self.options, self.splitters

        def run(batches):
            for b in batches:
                rows, index, texts, crumbs = [], [], [], []
                for r, t in enumerate(b.column(len(keep)).to_pylist()):
                    for i, (chunk_text, path) in enumerate(chunks(t, options, splitters)):
                        rows.append(r), index.append(i), texts.append(chunk_text)
                        crumbs.append([{"text": c, "depth": d} for c, d in path])
                made = [pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(crumbs, _CRUMBS)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in b.columns[: len(keep)]), *made], names=[*keep, *schema.names])

        return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(keep)], *schema.fields]))


def chunk(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``Chunker(Options(**options)).transform(df, text)``."""
    return Chunker(Options(**options)).transform(df, text)


@lru_cache(maxsize=16)
def _options(chunk_size, max_overflow_ratio, max_raw_size, rules: str | None) -> Options:
    """The options that the arguments of the table function stand for."""
    return Options(float(chunk_size), None if max_overflow_ratio is None else float(max_overflow_ratio), max_raw_size, None if rules is None else json.loads(rules))


class ChunkFunction:
    """Table function chunk(text, chunk_size, max_overflow_ratio, max_raw_size, rules). ``rules`` is JSON: an object with a
    rule for each kind, as a name ("never-split") or an object with split and style; without it the default rules hold.
    (Transforms are functions and cannot be given in SQL.)"""

    def eval(self, text, chunk_size, max_overflow_ratio=None, max_raw_size=None, rules=None):
        for i, (t, crumbs) in enumerate(chunks(text, _options(chunk_size, max_overflow_ratio, max_raw_size, rules))):
            yield i, t, [{"text": c, "depth": d} for c, d in crumbs]


def register(spark: SparkSession, name: str = "chunk") -> None:
    """Make the chunker available to SQL: ``SELECT ... FROM docs, LATERAL chunk(text, 500)``."""
    spark.udtf.register(name, F.udtf(ChunkFunction, returnType=CHUNK))
