"""DataFrame operators: chunking, block tables, section windows, greedy packing, interval merging."""

from .blocks import blocks, section_paths, section_sizes
from .chunk import Chunker, chunk
from .packing import greedy_groups, merge_intervals

__all__ = ["Chunker", "blocks", "chunk", "greedy_groups", "merge_intervals", "section_paths", "section_sizes"]
