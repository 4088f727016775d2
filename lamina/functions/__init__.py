"""Sizes, types, column specifications and coercion."""
