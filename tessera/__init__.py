"""Cohort and treatment-effect analytics on Spark."""
