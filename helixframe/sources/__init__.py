"""Readers of biological text formats and writers of results."""
