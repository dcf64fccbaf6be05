"""Operators for training corpora; nothing else in this package imports them."""
