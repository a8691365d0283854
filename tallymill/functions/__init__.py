"""Column expressions: the log line format and the scoring formulas."""
