"""Operators of a training-data pipeline: tokenizing, de-duplication, search, scans, formatting."""
