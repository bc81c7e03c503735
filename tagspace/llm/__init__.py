"""Operators of a training-data pipeline over documents and pages, each a Spark job."""
