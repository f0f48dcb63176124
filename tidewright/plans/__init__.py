"""Query engine and the registry of queries with their SQL."""
