"""Operators for preparing training data: each module holds one operator.

Nothing outside this folder imports it; ``queries.py`` lists the registered
queries of the folder.
"""
