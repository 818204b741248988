"""Operators for large training corpora, built on the DataFrame API.

Nothing else in the library imports this subpackage.
"""
