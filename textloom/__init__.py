"""textloom: a Spark-first engine that turns raw web and document collections into training text."""

__version__ = "0.1.0"
