"""Operators of a training-data pipeline over `documents`, `embeddings` and `pages`.

Each module holds one operator with its own interface; `queries` registers the thin `opN_` queries.
"""
