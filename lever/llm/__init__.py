"""Training-data operators: near-duplicates, counts, scoring, filters, formats.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries; every operator module has its own general interface.
"""
