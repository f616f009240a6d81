"""fotolake: a Spark-first engine for media-library catalogs."""

__version__ = "0.1.0"
