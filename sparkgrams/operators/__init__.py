"""Corpus, searches, joins and pair comparison."""

from .corpus import Corpus, CorpusBuilder, ngram_rows
from .pairs import compare_pairs, match_pairs
from .search import search, search_batch, similarity_join

__all__ = ["Corpus", "CorpusBuilder", "compare_pairs", "match_pairs", "ngram_rows", "search", "search_batch", "similarity_join"]
