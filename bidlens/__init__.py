"""Procurement-document analytics on Spark DataFrames."""
