"""Column functions: calendar, measures, labels, probability tails."""
