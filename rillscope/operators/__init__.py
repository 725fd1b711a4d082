"""Relational operators over samples, change points and periods."""
