"""Operators for training-data pipelines over tables of documents.

Nothing else in the library imports this package.  Each module holds one operator with its own general
interface; ``queries`` derives the contract's digest columns from the operators' outputs.
"""
