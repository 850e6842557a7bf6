"""Training-data operators: ten pipeline components over ``documents``-like tables.

Nothing else in the library imports this package.
"""
