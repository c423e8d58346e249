"""Relational operators: lookups, ordered counts and the category closure."""
