"""tessera: a Spark-first engine for dense monthly series, motif mining and rank statistics."""

__version__ = "0.1.0"
