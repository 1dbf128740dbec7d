"""Operators for preparing training data, on Spark DataFrames.

Each module holds one operator with its own general interface; `queries` applies them to
the test tables and derives the contract columns. Nothing outside this subpackage (and
`corpus_pipeline.py`) imports it.
"""
