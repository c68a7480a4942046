"""Operators that prepare training data: one module per operator, all DataFrame to DataFrame."""
