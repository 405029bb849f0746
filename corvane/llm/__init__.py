"""Operators of a training-data pipeline: scoring, joins, formatting, filtering, mixing and file output.

Nothing outside this subpackage imports it.
"""
