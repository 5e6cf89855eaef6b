"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it; ``queries.py`` holds the registry
that the driver entry point adds when the subpackage is present.
"""
