"""Plan shapes shared by the operators: windows, chunked scans, exact quantiles, pair blocks."""
