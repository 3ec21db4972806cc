"""Operators that prepare text and entity data for language models."""
