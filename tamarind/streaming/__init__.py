"""Streaming readers of table changes (an extension)."""
