"""Operators for building training corpora, and the queries that apply them.

Nothing else in the library imports this subpackage."""
