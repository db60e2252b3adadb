"""Training-data operators: packing, archives, sharding, quality, media, mixing, counts, near duplicates, ids, HTML.

Nothing outside this subpackage imports it.
"""
