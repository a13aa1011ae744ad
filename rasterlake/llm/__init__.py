"""Training-data operators: classifiers, near-duplicate joins, tokenisation, packing.

Nothing outside this subpackage imports it.
"""
