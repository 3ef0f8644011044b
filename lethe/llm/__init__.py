"""Operators of a training-data pipeline over a table of documents.

One module per operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""
