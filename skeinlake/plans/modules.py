"""Modules whose import registers queries."""

from . import assessment, chunking, collections, embedding, expansion, filtering, graph_writes, graphs, intervals, learners, paths, prose, reads, recommend, relational, search, streams, structure, text_search, texts, vector_search, versioned  # noqa: F401
