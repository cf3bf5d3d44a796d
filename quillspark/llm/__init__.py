"""Training-data operators: deduplication, mixing, packing, scoring, scans, search, sharding, language ID.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
