"""Operators for preparing text corpora at scale: one module per operator.

Each module holds a general operator (DataFrame in, DataFrame out) and, at its end, the
query that applies it to a whole table. ``registry`` lists the queries and their SQL.
"""
