"""Narrative text analytics and training-data preparation on PySpark."""
