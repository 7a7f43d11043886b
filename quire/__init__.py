"""Quire: structure-aware document analytics on Spark DataFrames."""
