"""Table-valued operators: windows, thresholds, aggregates, trends, densities."""
