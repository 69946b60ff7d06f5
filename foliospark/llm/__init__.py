"""Training-data operators: chat formatting, deduplication, classifiers, WARC
derivatives, tokenisation, token files, packing and similarity joins.

Nothing outside this subpackage imports it.
"""
