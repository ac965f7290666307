"""Operators for text corpora and streaming pairing; nothing else in the library imports this."""
