"""Operators for preparing large text corpora, one module for each.

Nothing else in the library imports this subpackage.
"""
