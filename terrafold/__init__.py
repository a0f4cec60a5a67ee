"""Point-cloud, frame-stream and record analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
