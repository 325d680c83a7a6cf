"""Terminology mining and corpus preparation on Spark."""
