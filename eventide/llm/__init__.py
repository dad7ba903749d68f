"""Operators that prepare training text for language models, and the queries that apply them."""
