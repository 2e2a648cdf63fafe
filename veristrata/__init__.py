"""Claim verification and corpus analytics on Spark DataFrames."""
