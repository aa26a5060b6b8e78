"""tablehaul: plan, validate and move relational tables with Spark."""

__version__ = "0.1.0"
