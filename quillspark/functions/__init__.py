"""Functions of package analytics."""
