"""Operators for the text of training corpora; nothing outside imports this."""
