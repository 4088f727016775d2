"""Operators for preparing training data at corpus scale; nothing else in lamina imports this package."""
