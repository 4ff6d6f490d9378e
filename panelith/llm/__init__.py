"""Training-data pipeline operators (deduplication, packing, filtering, mixing, storage, scoring).

Nothing else in the library imports this subpackage.
"""
