"""Training-data operators on documents: mixing, deduplication, scoring, counting, packing.

Nothing outside this package imports it; the entry module adds its queries only
if the package can be imported.
"""
