"""Tables over Parquet folders, generators of test data, and key-value snapshots."""
