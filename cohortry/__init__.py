"""Spark jobs for longitudinal cohorts: linkage, quality control, and evaluation of models."""
