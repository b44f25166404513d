"""Subpackage of the analytics engine."""
