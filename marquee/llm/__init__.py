"""Operators for preparing training corpora: each module holds one operator, ``queries`` applies them to the given tables."""
