"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered ``opN_<name>`` queries, every other module one operator.
"""
