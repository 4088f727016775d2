"""Registered queries over the store."""
