"""Relational operators, statistics, access paths and changes of tables."""
