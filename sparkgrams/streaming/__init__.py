"""Structured Streaming over a corpus."""

from .search import append_stream, generations, search_stream

__all__ = ["append_stream", "generations", "search_stream"]
