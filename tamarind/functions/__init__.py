"""Functions on columns and values."""
