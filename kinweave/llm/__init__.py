"""Training-data operators: one module each, with their registered queries in ``queries``.

Nothing else in the library imports this package.
"""
