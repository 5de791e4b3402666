"""quillspark: package analytics and corpus preparation as PySpark jobs."""
