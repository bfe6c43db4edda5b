"""Column-valued functions: risk measures, statistics and cost formulas."""
