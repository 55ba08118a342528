"""Training-data operators: dedup, filtering, mixing, sharding, tokenising, search.

Nothing else in ``quern`` imports this subpackage.
"""
