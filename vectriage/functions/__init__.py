"""Column expressions. All are built-in Spark functions."""

from . import mixing, text, vectors  # noqa: F401
