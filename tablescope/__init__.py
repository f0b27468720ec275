"""tablescope: profile, clean, summarise, find outliers in, trend and chart
any Spark DataFrame, with every step expressed as Spark DataFrame operations."""

__version__ = "0.1.0"
