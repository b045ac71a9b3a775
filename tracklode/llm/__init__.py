"""Training-data operators: one module per operator, each usable on its own.

Nothing outside this subpackage imports it.  Every operator module documents
what it does with nulls, empty texts, ties, repeated rows and empty tables.
"""
