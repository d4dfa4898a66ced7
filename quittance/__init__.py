"""Receivables analytics on Spark: raw billing extracts to one trusted row per invoice."""
