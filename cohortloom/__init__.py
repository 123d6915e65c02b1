"""Cohort analytics on Spark: cleaning, auditing, comparing, splitting, preparing and survival analysis of dirty tables."""

__version__ = "0.1.0"
