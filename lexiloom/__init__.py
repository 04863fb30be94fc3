"""Bilingual training-data engine on Spark DataFrames."""
