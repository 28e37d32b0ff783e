"""Operators for language-model training data and their algorithms; nothing outside imports this package."""
