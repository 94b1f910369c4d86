"""Redaction-leakage analytics and corpus operators, expressed as Spark DataFrames."""
