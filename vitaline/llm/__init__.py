"""Operators for preparing text corpora; optional, nothing else in the library imports them."""
