"""tagspace: comparing groups of authors by what they write, as Spark DataFrame jobs."""

__version__ = "0.1.0"
