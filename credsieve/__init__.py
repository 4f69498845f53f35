"""Credential-leak analytics on Spark: sources, detection, scoring, suppression, reports and traces as DataFrames."""
