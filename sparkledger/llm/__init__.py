"""Corpus and training-data operators; nothing outside this folder imports it."""
