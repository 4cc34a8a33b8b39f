"""Verbarium: corpus analytics as functions from DataFrames to DataFrames."""
