"""Operators for large training-data pipelines.

Each module holds one operator with its general interface, the thin query built
on it and, where SQL can express the result, the SQL that states it.
"""
