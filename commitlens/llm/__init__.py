"""Operators for preparing training data: one module per operator.

``register`` lists their queries.  Nothing outside this folder imports it; the
entry point adds the queries if the folder is there.
"""
