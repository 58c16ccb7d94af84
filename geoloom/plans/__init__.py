"""Composed plans: whole queries built from the operators."""
