"""Operators for large training corpora; nothing outside this folder imports them."""
