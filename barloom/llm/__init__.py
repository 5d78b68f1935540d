"""Operators that prepare text corpora for training large models.

Nothing else in the library imports this subpackage.  Every operator is a
function over DataFrames with a general interface; ``queries`` holds the thin
registered queries built on them.
"""
