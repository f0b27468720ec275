"""DataFrame -> DataFrame operators: profiling, statistics, outliers, cleaning,
trends, chart data and declared transformation steps."""
