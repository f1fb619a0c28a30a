"""Operators for training-data pipelines, each usable alone on a DataFrame."""
