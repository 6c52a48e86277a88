"""Versioned-drive analytics on Spark DataFrames."""

from palimpsest.session import session, shared_dir, tables

__all__ = ["session", "shared_dir", "tables"]
