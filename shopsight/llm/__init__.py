"""Operators of a training-data pipeline: filtering, near duplicates, mixing, models and file formats."""
