"""Operators for texts of training data."""
