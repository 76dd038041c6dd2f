"""DataFrame operators: joins, scans, row shaping, aggregates and set operations."""
