"""Credit-risk analytics on Spark: rule mining, scorecards, data quality."""

__version__ = "0.1.0"
