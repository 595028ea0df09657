"""Aeronautical data work as Spark DataFrame jobs (study and analysis only, not for navigation)."""
