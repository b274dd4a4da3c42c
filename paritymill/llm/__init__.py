"""Training-data operators: one module per operator, queries and SQL beside them.

Nothing else in the library imports this package.
"""
