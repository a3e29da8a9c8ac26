"""SQL equivalents of the named queries."""
