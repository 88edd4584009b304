"""Cleaning and profiling of text columns on Spark."""
