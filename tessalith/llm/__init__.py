"""Training-data operators: joins on shingles, classifiers, mixing, encoding.

Nothing outside this subpackage imports it.
"""
