"""Operators on training data for language models; nothing else in the library imports them."""
