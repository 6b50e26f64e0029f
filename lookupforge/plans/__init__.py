"""Whole training and evaluation plans, and the registered queries."""
