"""Operators for text corpora and learned-key problems; nothing outside imports this."""
