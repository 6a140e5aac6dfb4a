"""Operators for preparing language-model training data.

Nothing outside this folder imports it; each module is one operator with a
DataFrame-in, DataFrame-out interface, and ``queries`` holds the registered
queries and their SQL.
"""
