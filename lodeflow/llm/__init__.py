"""Operators for text and training-data problems; nothing outside this folder imports it."""
