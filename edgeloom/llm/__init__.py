"""Operators of a training-data pipeline: filtering, de-duplication, scoring, tokenising and packing."""
