"""Helpers that shape physical plans: staged tables and session settings."""
