"""Plans of package analytics."""
