"""Operators for large training corpora: one module per operator, their queries in ``queries``."""
