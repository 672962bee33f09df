"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; :mod:`textwarden.llm.queries`
holds the queries and their SQL.
"""
