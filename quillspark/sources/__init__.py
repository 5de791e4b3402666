"""Sources of package analytics."""
