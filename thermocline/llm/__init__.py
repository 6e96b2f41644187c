"""Operators of a training-data pipeline: thirteen operators on corpora, conversations and vectors, each from DataFrame to DataFrame.

Nothing else in the library imports this package.
"""
