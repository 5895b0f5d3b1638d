"""Operators for training-data pipelines: tokens, quality, copies, leaks."""
