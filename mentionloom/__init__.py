"""mentionloom: a Spark-first engine for linking mentions across related documents."""

__version__ = "0.1.0"
