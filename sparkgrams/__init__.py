"""Fuzzy string matching with character n-grams on Spark DataFrames."""

from .functions import GramConfig, KeyTransformer, Pad
from .operators import Corpus, CorpusBuilder, search_batch, similarity_join

__all__ = ["Corpus", "CorpusBuilder", "GramConfig", "KeyTransformer", "Pad", "search_batch", "similarity_join"]
