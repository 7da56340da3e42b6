"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin registered queries live in :mod:`attestra.llm.queries`.
"""
