"""Log, error and web-traffic analytics expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
