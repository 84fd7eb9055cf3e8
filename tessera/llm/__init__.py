"""Operators for building training corpora. Nothing else in tessera imports this subpackage."""
