"""Operators for preparing training data: ten corpus operators and their queries."""
