"""Operators of a training-data pipeline: search, dedup, filtering, mixing, tokens.

Each module holds one operator with a general DataFrame interface. The thin
registered queries are in `codesift.llm.queries`. Nothing outside this
subpackage imports it.
"""
