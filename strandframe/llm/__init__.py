"""Operators for large text corpora: rules, duplicates, scores, formats and packing.

Nothing else in the library imports this package.  Every operator takes the names of
its columns as parameters, reads only these, and has its own result columns.
"""
