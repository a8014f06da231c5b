"""Training-data pipeline operators.

Each operator is a module with a general interface on DataFrames; the thin
contract queries and their SQL live in ``queries``.  Nothing outside this
subpackage imports it.
"""
