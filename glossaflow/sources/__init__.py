"""Readers and writers: EPUB archives, XHTML, tables of contents, configuration."""
