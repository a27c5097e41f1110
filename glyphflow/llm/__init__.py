"""Training-data operators: packing, near-duplicates, tokenisers, classifiers, media.

Nothing outside this subpackage imports it.
"""
