"""Training-data operators (near-duplicates, tokens, quality, mixing) for very large corpora.

Self-contained: nothing else in ``qlift`` imports this subpackage.
"""
