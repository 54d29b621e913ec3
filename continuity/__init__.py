"""continuity: keep a second copy of a data estate in step with the first, on Spark."""

__version__ = "0.1.0"
