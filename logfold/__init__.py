"""Log-structured analytics on Spark: every table is the fold of an ordered commit log."""

__version__ = "0.1.0"
