"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries.  Nothing outside this subpackage imports it.
"""
