"""Operators for training-data pipelines over texts; nothing outside this subpackage imports it."""
