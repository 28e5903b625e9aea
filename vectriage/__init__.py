"""vectriage: Spark-first analytics for evaluating fixed vector embeddings on multi-label data."""

__version__ = "0.1.0"
