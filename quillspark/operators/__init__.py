"""Operators of package analytics."""
