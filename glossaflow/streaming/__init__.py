"""Incremental runs: new segments stream in, the translation memory follows."""
