"""Training-data operators: deduplication, scoring, tokenizing, packing, archives and media.

Nothing outside this package imports it; ``__spark_entry__`` registers its queries when it
can be imported.
"""
