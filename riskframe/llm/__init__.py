"""Operators of a training-data pipeline: text, pages and vectors in, digests, joins, models and files out.

Nothing else in the package imports this subpackage.  ``queries`` registers one query for each operator.
"""
