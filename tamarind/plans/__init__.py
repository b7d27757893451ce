"""From SQL text to DataFrames: parsing, binding, range analysis, explanation."""
