"""Streaming of package analytics."""
