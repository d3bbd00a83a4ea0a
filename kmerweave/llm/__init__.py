"""Operators for preparing language-model training data, each a Spark job over a documents-like table.

Nothing outside this subpackage imports it; ``registry`` holds the queries and their SQL.
"""
