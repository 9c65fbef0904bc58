"""Keep document indexes in step with their sources, as Spark jobs."""

__version__ = "0.1.0"
