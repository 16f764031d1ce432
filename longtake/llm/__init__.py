"""Operators for training data: formatting, filtering, removal of copies, mixing, encoding."""
