"""Whole plans: fixture views, the SQL that checks them, and the linkage pipelines."""
