"""Operators for corpora of language-model training text; nothing else in the library imports them."""
