"""Operators for large text and vector corpora (training-data pipelines).

Nothing else in the library imports this subpackage; the registry picks its
queries up when it can be imported.  Each module holds one operator, its
docstring states the method, the result and what happens to nulls, empty
texts, ties, repeated rows and extra columns.  ``queries`` registers them.
"""
