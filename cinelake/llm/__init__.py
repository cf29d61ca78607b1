"""Training-data operators: tokenising, packing, deduplication, scoring and scans.

Nothing outside this package imports it.  Each module holds one operator with a general
interface (any table, any id and text column); ``registry`` derives the contract queries from them.
"""
