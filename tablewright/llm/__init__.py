"""Operators for preparing training corpora. Nothing outside this folder imports it."""
