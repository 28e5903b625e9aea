"""Readers and writers."""

from . import readers, writers  # noqa: F401
