"""Operators for large text corpora; queries in ``queries``, their SQL in ``sql``."""
