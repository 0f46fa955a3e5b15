"""Utility-loss analytics expressed as Spark DataFrame jobs over all feeders at once."""
