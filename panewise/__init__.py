"""Exact distance-based outlier analytics over sliding windows, as Spark plans."""
