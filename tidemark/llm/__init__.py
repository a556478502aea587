"""Operators for building training corpora: mixing, deduplication, filtering, packing, sharding.

Every operator takes DataFrames and returns DataFrames.  Nothing else in the
library imports this subpackage.
"""
