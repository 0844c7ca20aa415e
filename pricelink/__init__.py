"""Batch jobs on price lists, written on the DataFrame API."""
