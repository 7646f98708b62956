"""Spark-native Markdown chunking: documents in, retrieval-sized chunks out."""

from .markdown.chunking import NodeSplitter, Splitter
from .markdown.options import ALLOW, BY_SIZE, DEFAULT_RULES, NEVER, REMOVE, Options, Rule
from .operators.chunk import Chunker, chunk, register

__all__ = ["ALLOW", "BY_SIZE", "Chunker", "DEFAULT_RULES", "NEVER", "NodeSplitter", "Options", "REMOVE", "Rule", "Splitter", "chunk", "register"]
