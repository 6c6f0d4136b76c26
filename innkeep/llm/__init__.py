"""Operators for training-data pipelines (search, joins, tagging, scoring, mixing, output).

Nothing else in the library imports this subpackage; its queries are in
:mod:`innkeep.llm.queries`.
"""
