"""Training-data operators: ten Spark jobs over documents, pages and benchmark items.

Nothing else in the package imports this subpackage.
"""
