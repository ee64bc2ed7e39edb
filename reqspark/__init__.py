"""PySpark jobs for requirements engineering and fine-tuning data."""
