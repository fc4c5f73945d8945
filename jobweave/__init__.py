"""PySpark engine for job-advertisement data."""
