"""Registered queries and workload plans."""
