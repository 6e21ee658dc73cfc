"""Keelson: table migration, conversion and reconciliation on Spark DataFrames."""
