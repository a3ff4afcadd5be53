"""Leakage audit and evaluation analytics as DataFrame-to-DataFrame operators."""
