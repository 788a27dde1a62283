"""Operators of a training-data pipeline: near duplicates, packing, filters, search.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it is there.
"""
