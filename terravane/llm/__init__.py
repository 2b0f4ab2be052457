"""Operators for language-model data; nothing outside this package imports it."""
