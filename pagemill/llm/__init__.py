"""Operators for training-data pipelines over tables of documents.

Shared rules.  An operator reads the columns it is told to read and ignores all
others, so further columns never clash with what it makes.  A null text counts
as the empty text unless the docstring says otherwise.  Rows are never dropped,
capped or sampled: each input row yields its result row, repeated ones too.
An empty table yields an empty result of the same schema.
"""
