"""Operators that prepare training text: filtering, deduplication, masking, packing, sharding.

Nothing else in the library imports this subpackage.
"""
