"""Operators that prepare language-model training data: one module for each, and their queries."""
