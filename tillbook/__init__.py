"""Retail analytics on Spark: two-channel rankings, till reports, stock and payment ledgers."""
