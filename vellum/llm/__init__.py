"""Training-data operators: search, dedup, decontamination, archives, tokenization, classifiers.

Nothing outside this subpackage imports it; the queries and their SQL are in ``queries``.
"""
