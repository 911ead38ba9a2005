"""Column functions: padding, n-grams, transformers, similarity."""

from .config import GramConfig, Pad
from .grams import char_count, contains, count_gram, count_grams, explode_grams, gram_map, is_empty, ngrams, pad_text
from .similarity import all_grams, diff_grams, matches, same_grams, similarity, similarity_single
from .transforms import KeyTransformer, from_pandas, identity, lower, register, strip_scheme

__all__ = [
    "GramConfig", "KeyTransformer", "Pad", "all_grams", "char_count", "contains", "count_gram", "count_grams", "diff_grams",
    "explode_grams", "from_pandas", "gram_map", "identity", "is_empty", "lower", "matches", "ngrams", "pad_text", "register",
    "same_grams", "similarity", "similarity_single", "strip_scheme",
]
