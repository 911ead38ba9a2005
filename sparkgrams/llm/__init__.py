"""Operators for preparing large-scale training text: deduplication, filters,
classifiers, token counts, packing, search and decontamination.

Nothing else in the library imports this subpackage.
"""
