"""Table analytics on Spark: load, clean, profile, chart, compare and rank findings."""

__all__ = ["config", "functions", "operators", "plans", "session", "sources"]
