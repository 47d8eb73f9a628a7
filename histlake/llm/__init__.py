"""Training-data operators: dedup, scoring, extraction, packing and sharding.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``registry`` holds the queries built from them.
"""
