"""Operators for building language-model training data.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
Each operator module keeps a general interface, and ``queries.py`` derives the
registered ``opN_<name>`` results from them.
"""
