"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns DataFrames;
the thin queries over the driver's tables are in :mod:`phylospan.llm.queries`.
"""
