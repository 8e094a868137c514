"""Relational operators of the localisation engine."""
