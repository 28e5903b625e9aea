"""Results that grow as files of scores arrive."""

from .incremental import counts_by_window, fold_in, ingest_pools  # noqa: F401
